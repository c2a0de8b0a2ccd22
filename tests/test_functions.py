import datetime as dt

from pyspark.sql import functions as F

from railpulse.functions import expr as X
from railpulse.functions.ranges import TimeRange
from railpulse.functions.scope import code_from_scope, scope_from_code
from railpulse.operators.dataops import in_service_hours


def test_round1_half_up(spark):
    r = spark.range(1).select(X.round1(F.lit(-2.25)).alias("a"), X.round1(F.lit(2.25)).alias("b"),
                              X.round1(F.lit(7.333)).alias("c")).first()
    assert (r.a, r.b, r.c) == (-2.2, 2.3, 7.3)


def test_categories_and_labels(spark):
    df = spark.createDataFrame([(v,) for v in (-3, 0, 4, 5, 9, 10, 19, 20, 39, 40, 500)], "v int")
    got = [r[0] for r in df.select(X.delay_category("v")).collect()]
    assert got == ["Extreme Delay", "On Time", "On Time", "Small Delay", "Small Delay", "Medium Delay",
                   "Medium Delay", "Big Delay", "Big Delay", "Extreme Delay", "Extreme Delay"]
    early = [r[0] for r in df.limit(1).select(X.delay_category("v", early_as_on_time=True)).collect()]
    assert early == ["On Time"]
    lab = df.limit(1).select(X.category_label(F.lit("Small Delay"))).first()[0]
    assert lab == "Small Delay (5–9 min)"


def test_scalars(spark):
    r = spark.range(1).select(
        X.due_in_display(F.lit(0)).alias("a"), X.due_in_display(F.lit(7)).alias("b"),
        X.station_display_name(F.lit(" "), F.lit("Desc")).alias("c"),
        X.station_display_name(F.lit("Al"), F.lit("Desc")).alias("d"),
        X.hour_label(F.lit(8)).alias("e"), X.delay_probability(F.lit(2), F.lit(3)).alias("f"),
        X.delay_probability(F.lit(0), F.lit(0)).alias("g"), X.reliability_band(F.lit(25.0)).alias("h"),
        X.endpoint_or_unknown(F.lit("")).alias("i")).first()
    assert tuple(r) == ("A chegar", "7 min", "Desc", "Al", "08:00", 66.7, 0.0, "medium", "Unknown")


def test_time_range():
    as_of = dt.datetime(2025, 5, 12, 15, 30)
    r = TimeRange.of_dates("2025-05-01", "2025-05-12", as_of)
    assert r.start == dt.datetime(2025, 5, 1) and r.end == dt.datetime(2025, 5, 13)
    assert TimeRange.of_dates(None, None, as_of).start == dt.datetime(2000, 1, 1)
    assert TimeRange.of_dates(None, None, as_of).end == as_of + dt.timedelta(days=1)
    assert TimeRange.of_dates(None, None, as_of, open_end="midnight").end == dt.datetime(2025, 5, 13)
    assert TimeRange.of_dates("not-a-date", None, as_of).start == dt.datetime(2000, 1, 1)
    assert TimeRange.period("all", "2025-01-01", None, as_of).start == dt.datetime(2000, 1, 1)
    assert TimeRange.period(None, None, None, as_of) == TimeRange.of_dates("2025-05-12", "2025-05-12", as_of)
    assert TimeRange.preset("last7", as_of).start == dt.datetime(2025, 5, 6)
    assert TimeRange.preset("yesterday", as_of).end == dt.datetime(2025, 5, 12)


def test_scope_codes():
    assert scope_from_code("hston") == "HEUSTON" and scope_from_code("Connolly") == "CONNOLLY"
    assert scope_from_code("XYZ") is None and code_from_scope("heuston") == "HSTON"
    assert code_from_scope(None) == "OVERVIEW"


def test_service_hours(spark):
    times = ["2024-01-01 05:59:59", "2024-01-01 05:59:59.5", "2024-01-01 06:00:00", "2024-01-01 00:30:59",
             "2024-01-01 00:31:00", "2024-01-01 03:00:00", "2024-01-01 23:59:59"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    got = [r[0] for r in df.select(in_service_hours("ts")).collect()]
    assert got == [False, True, True, True, False, False, True]


def test_zone_independent_times(spark):
    """Wall-clock fields must not shift with the session zone (DST gaps)."""
    from railpulse.functions.expr import hhmm, hhmmss, iso_date
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("1997-04-06 02:30:15",)], "t string") \
            .select(F.col("t").cast("timestamp_ntz").alias("ts"))
        r = df.select(hhmm("ts"), hhmmss("ts"), iso_date("ts"), in_service_hours("ts")).first()
        assert tuple(r) == ("02:30", "02:30:15", "1997-04-06", False)
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
