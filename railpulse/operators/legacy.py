"""Legacy denormalised-record reports (composite trip key).

The legacy record is a snapshot with its trip columns copied in; here it is a
view over snapshot ⋈ trip.  A "trip" is the 4-tuple
(train_code, station_code, train_date, sch_depart), NULL parts included.

Plan: reduce snapshots per (trip_id, snapshot-side key parts) before the trip
join (``trip_peaks``), then regroup on the composite key.  Two trips with the
same (train_code, train_date) merge in the regroup, as they do when grouping
the denormalised rows directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.functions.constants import (
    DELAYED_MIN, LIMIT_DAYS, LIMIT_DESTINATIONS, LIMIT_RECENT_ROWS, LIMIT_STATIONS, LIMIT_TRAINS,
    LIMIT_TRIPS,
)
from railpulse.functions.expr import count_if, delay_probability, non_empty, round1, safe_ratio, sum_if
from railpulse.functions.ranges import TimeRange
from railpulse.functions.scope import ScopeFilter
from railpulse.operators.peaks import PeakSpec, trip_peaks
from railpulse.operators.reports import newest_window
from railpulse.sources.tables import RailData

KEY_SNAPSHOT = ("station_code", "sch_depart")
KEY_TRIP = ("train_code", "train_date")
LEGACY_KEY = ("train_code", "station_code", "train_date", "sch_depart")
NETWORK = ScopeFilter.network()


def records(data: RailData, window: TimeRange | None = None, filt: ScopeFilter = NETWORK) -> DataFrame:
    """O-S13: the denormalised record view."""
    s = data.snapshots(window)
    pred = filt.station_predicate()
    if pred is not None:
        s = s.where(pred)
    t = data.trips()
    return s.join(t, "trip_id", "inner").select(
        "train_code", "station_code", "station_full_name", "train_date", "sch_depart", "sch_arrival",
        "exp_depart", "exp_arrival", "status", "late_minutes", "captured_at", "train_type", "origin",
        "destination", "direction")


def _groups(data, window, filt, snap_dims, trip_cols, first_seen=False, min_late=None,
            cap=None) -> DataFrame:
    spec = PeakSpec(window=window, filt=filt, cap=cap, min_late=min_late,
                    dims=tuple((d, F.col(d)) for d in snap_dims), trip_cols=tuple(trip_cols),
                    first_seen=first_seen, need_join=True)
    tp = trip_peaks(data, spec)
    aggs = [F.sum("snapshot_count").cast("long").alias("snapshot_count"),
            F.max("peak_delay").alias("peak_delay")]
    if first_seen:
        aggs.append(F.min("first_seen").alias("first_seen"))
    return tp.groupBy(*snap_dims, *trip_cols).agg(*aggs)


def _per_trip(data, window, filt, *dims, **aggs) -> DataFrame:
    """Snapshot aggregates of each trip and ``dims``, of trips that exist: the join is at trip grain."""
    s = data.snapshots(window)
    pred = filt.station_predicate()
    if pred is not None:
        s = s.where(pred)
    pre = s.groupBy("trip_id", *dims).agg(*[c.alias(n) for n, c in aggs.items()])
    return pre.join(data.trips().select("trip_id"), "trip_id")


def record_count(data, window, filt=NETWORK) -> DataFrame:
    return _per_trip(data, window, filt, n=F.count(F.lit(1))).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("records"))


def max_delay(data, window, filt=NETWORK) -> DataFrame:
    return _per_trip(data, window, filt, p=F.max("late_minutes")).agg(F.max("p").alias("max_delay"))


def unique_trips(data, window, filt=NETWORK) -> DataFrame:
    """Distinct 4-tuples; tuples with NULL parts count (SELECT DISTINCT)."""
    g = _groups(data, window, filt, KEY_SNAPSHOT, KEY_TRIP)
    return g.agg(F.count(F.lit(1)).alias("unique_trips"))


def delayed_trips(data, window, filt=NETWORK, min_delay=DELAYED_MIN) -> DataFrame:
    g = _groups(data, window, filt, KEY_SNAPSHOT, KEY_TRIP)
    return g.agg(F.coalesce(count_if(F.col("peak_delay") >= min_delay), F.lit(0)).cast("long")
                 .alias("delayed_trips"))


def avg_peak(data, window, filt=NETWORK, min_delay=DELAYED_MIN) -> DataFrame:
    g = _groups(data, window, filt, KEY_SNAPSHOT, KEY_TRIP).where(F.col("peak_delay") >= min_delay)
    return g.agg(F.coalesce(F.avg(F.col("peak_delay").cast("double")), F.lit(0.0)).alias("avg_peak_delay"))


def peak_delays(data, window, filt=NETWORK, min_delay=DELAYED_MIN) -> DataFrame:
    g = _groups(data, window, filt, KEY_SNAPSHOT, KEY_TRIP)
    return g.where(F.col("peak_delay") >= min_delay).select(F.col("peak_delay").cast("int"))


def station_stats(data, window, min_delay=DELAYED_MIN, limit=LIMIT_STATIONS) -> DataFrame:
    g = _groups(data, window, NETWORK, ("station_code", "station_full_name", "sch_depart"), KEY_TRIP)
    delayed = F.col("peak_delay") >= min_delay
    r = g.groupBy("station_code", "station_full_name").agg(
        F.count(F.lit(1)).alias("total_trips"),
        count_if(delayed).alias("delayed_trips"),
        sum_if(delayed, "peak_delay").alias("_total"),
    ).withColumn("_avg", safe_ratio("_total", "delayed_trips"))
    order = [F.col("delayed_trips").desc(), F.col("_avg").desc(), F.col("station_code").asc(),
             F.col("station_full_name").asc()]
    r = r.orderBy(*order)
    if limit is not None:
        r = r.limit(limit)
    return r.select("station_code", "station_full_name", "total_trips", "delayed_trips",
                    round1("_avg").alias("average_delay"),
                    delay_probability("delayed_trips", "total_trips").alias("delay_probability"),
                    "_avg").orderBy(*order).drop("_avg")


def hourly(data, window, late_gt=0, filt=NETWORK) -> DataFrame:
    """Per hour of capture, by hour: records, records late > late_gt, their mean."""
    late = F.col("late_minutes") > late_gt
    per_trip = _per_trip(data, window, filt, F.hour("captured_at").alias("hour"), n=F.count(F.lit(1)), d=count_if(late),
                         m=sum_if(late, "late_minutes"))
    g = per_trip.groupBy("hour").agg(F.sum("n").cast("long").alias("total"), F.sum("d").cast("long").alias("delayed"),
                                     F.sum("m").cast("long").alias("_sum"))
    return g.select(F.col("hour").cast("int"), F.format_string("%02d:00", "hour").alias("hour_label"),
                    "total", "delayed", round1(safe_ratio("_sum", "delayed")).alias("avg_delay"),
                    delay_probability("delayed", "total").alias("delay_probability")).orderBy("hour")


TOP10_DIMS = ("station_full_name", "sch_depart", "sch_arrival")
TOP10_TRIP = ("train_code", "train_date", "direction", "origin", "destination")


def top10(data, window, min_delay=DELAYED_MIN, limit=LIMIT_TRIPS, filt=NETWORK) -> DataFrame:
    """Legacy largest delays: groups by 8 descriptive columns, no peak lookup."""
    g = _groups(data, window, filt, TOP10_DIMS, TOP10_TRIP).where(F.col("peak_delay") >= min_delay)
    cols = ("train_code", "station_full_name", "train_date", "sch_depart", "sch_arrival", "direction",
            "origin", "destination")
    order = [F.col("peak_delay").desc()] + [F.col(c).asc() for c in cols]
    return g.orderBy(*order).limit(limit).select(
        *cols, F.col("peak_delay").cast("int"), "snapshot_count").orderBy(*order)


def destinations(data, window, min_delay=DELAYED_MIN, limit=LIMIT_DESTINATIONS, filt=NETWORK) -> DataFrame:
    g = _groups(data, window, filt, KEY_SNAPSHOT, KEY_TRIP + ("destination",)) \
        .where(non_empty("destination"))
    delayed = F.col("peak_delay") >= min_delay
    r = g.groupBy("destination").agg(
        F.count(F.lit(1)).alias("total_trips"), count_if(delayed).alias("delayed_trips"),
        sum_if(delayed, "peak_delay").alias("_total")).where(F.col("delayed_trips") > 0) \
        .withColumn("_avg", safe_ratio("_total", "delayed_trips"))
    order = [F.col("_avg").desc(), F.col("destination").asc()]
    return r.orderBy(*order).limit(limit).select(
        "destination", "total_trips", "delayed_trips", round1("_avg").alias("average_delay"),
        delay_probability("delayed_trips", "total_trips").alias("delay_probability"),
        "_avg").orderBy(*order).drop("_avg")


def daily_delays(data, window, min_delay=DELAYED_MIN, limit=LIMIT_DAYS) -> DataFrame:
    g = _groups(data, window, NETWORK, KEY_SNAPSHOT, KEY_TRIP, first_seen=True) \
        .where(non_empty("train_date") & (F.col("peak_delay") >= min_delay))
    d = g.groupBy("train_date").agg(F.count(F.lit(1)).alias("delayed_trip_count"),
                                    F.min("first_seen").alias("date_seen"))
    order = [F.col("date_seen").desc(), F.col("train_date").asc()]
    return d.orderBy(*order).limit(limit).orderBy(*order)


def daily_simple(data, late_gt=0, limit=LIMIT_DAYS) -> DataFrame:
    """No window; any lateness > 0; newest train_date string first."""
    g = _groups(data, None, NETWORK, KEY_SNAPSHOT, KEY_TRIP) \
        .where(non_empty("train_date") & (F.col("peak_delay") > late_gt))
    d = g.groupBy("train_date").agg(F.count(F.lit(1)).alias("delayed_trip_count"))
    return d.orderBy(F.col("train_date").desc()).limit(limit).orderBy(F.col("train_date").desc())


def top_trains(data, min_delay=DELAYED_MIN, limit=LIMIT_TRAINS) -> DataFrame:
    g = _groups(data, None, NETWORK, KEY_SNAPSHOT, KEY_TRIP + ("train_type",))
    delayed = F.col("peak_delay") >= min_delay
    r = g.groupBy("train_code").agg(
        count_if(delayed).alias("delayed_trips"),
        F.coalesce(F.avg(F.when(delayed, F.col("peak_delay").cast("double"))), F.lit(0.0)).alias("_avg"),
        F.max("peak_delay").cast("int").alias("max_delay"))
    order = [F.col("delayed_trips").desc(), F.col("_avg").desc(), F.col("train_code").asc()]
    return r.orderBy(*order).limit(limit).select(
        "train_code", "delayed_trips", round1("_avg").alias("average_delay"), "max_delay", "_avg"
    ).orderBy(*order).drop("_avg")


def recent_rows(data, min_exclusive=DELAYED_MIN - 1, limit=LIMIT_RECENT_ROWS) -> DataFrame:
    """The newest records with late > min_exclusive (no outlier cap); the history is read from its newest end."""
    def late(window) -> DataFrame:
        return records(data, window).where(F.col("late_minutes") > min_exclusive)

    rec = late(newest_window(data, late, limit))
    order = [F.col("captured_at").desc(), F.col("train_code").asc(), F.col("station_code").asc(),
             F.col("sch_depart").asc(), F.col("late_minutes").asc(), F.col("train_date").asc()]
    return rec.select("train_code", "station_code", "station_full_name", "train_date", "sch_depart",
                      "late_minutes", "captured_at", "origin", "destination") \
        .orderBy(*order).limit(limit).orderBy(*order)
