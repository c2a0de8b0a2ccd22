"""Poll documents stay bounded when one poll holds a third of all rows."""

from pyspark.sql import functions as F

from railpulse.sources import payloads as P

ORDER, DEAL = ["trip_id", "sch_depart", "late_minutes"], ["train_code", "train_date", "sch_depart"]


def live(spark, rows):
    """(station, minute, train, late) as live rows."""
    df = spark.createDataFrame([(s, m, t, late, i) for i, (s, m, t, late) in enumerate(rows)], "station_code string, m int, train_code string, late_minutes int, i int")
    df = df.select("*", (F.lit("2025-01-01 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("m"))).alias("captured_at"),
                   F.xxhash64("train_code").alias("trip_id"), F.lit("10:00").alias("sch_depart"), F.lit("1 Jan").alias("train_date"))
    return df.withColumns({n: F.lit(None).cast("string") for _, n, _ in P.LIVE_FIELDS if n not in df.columns})


def documents(spark, rows):
    return P.poll_documents(live(spark, rows), ["station_code", "captured_at"], ORDER, DEAL)


def test_pages_of_a_hot_poll(spark):
    rows = [("HOT", 0, f"T{i % 900}", i // 900) for i in range(3000)] + [("HOT", 0, "same", 5)] * 2000
    rows += [(f"S{i % 50}", i % 7, f"T{i}", 1) for i in range(10_000)] + [(None, 1, "none", 1)] * 300
    docs = documents(spark, rows).cache()
    parsed = P.parse_live(docs.withColumnRenamed("station_code", "board"))
    sizes = parsed.groupBy("board", "captured_at", "page").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * P.POLL_PAGE
    assert sizes.where("board = 'HOT'").count() >= 5000 / P.POLL_PAGE
    want = sorted((s or "", t, late) for s, _, t, late in rows)
    assert sorted((r.board or "", r.train_code, r.late_minutes) for r in parsed.collect()) == want
    # a train's readings of a poll stay together and in order
    of_train = parsed.where("board = 'HOT' and train_code <> 'same'").groupBy("train_code").agg(
        F.count_distinct("page").alias("pages"), F.array_sort(F.collect_list(F.struct("position", "late_minutes"))).alias("l"))
    assert all(r.pages == 1 and [x.late_minutes for x in r.l] == sorted(x.late_minutes for x in r.l) for r in of_train.collect())


def test_small_polls_have_one_page(spark):
    docs = documents(spark, [("S", 0, "T", 1), ("S", 0, "T", 1), ("S", 1, "U", 2)])
    assert sorted((r.captured_at.minute, r.page) for r in docs.collect()) == [(0, 0), (1, 0)]
    assert P.parse_live(docs.drop("station_code")).count() == 3
    assert documents(spark, [("S", 0, "T", 1)]).where("false").count() == 0


def test_rows_travel_as_values(spark):
    docs = documents(spark, [("S", 0, "T", 1)])._jdf.queryExecution().optimizedPlan().toString()
    assert docs.index("<objStationData>") < docs.index("RepartitionByExpression")  # rendered above the shuffle
    assert "lambdafunction" not in docs  # two readers of one plan would not share its exchange


def test_a_caller_parses_the_fields_that_it_reads(spark):
    docs = documents(spark, [("S", 0, "T&<1>", 1), ("S", 0, "U", 2)])
    got = P.parse_live(docs.withColumnRenamed("station_code", "board"), columns=("train_code", "late_minutes"))
    assert got.columns == ["board", "captured_at", "page", "position", "train_code", "late_minutes"]
    assert sorted((r.train_code, r.late_minutes) for r in got.collect()) == [("T&<1>", 1), ("U", 2)]
