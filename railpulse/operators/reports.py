"""The punctuality report catalogue.

Each report is ``trip_peaks`` (or a snapshot-grain aggregate) followed by a
second aggregation, ordering and an optional limit.  Every function returns a
lazy DataFrame.  Ties that the reference leaves unspecified get explicit
tie-breakers so results are deterministic:
trips -> trip_id; stations -> station_code, station_full_name;
routes -> origin, destination; destinations -> destination;
trains -> train_code; days -> train_date.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.functions.constants import (
    BROADCAST_LIMIT, CATEGORIES, CATEGORY_LABELS, DELAYED_MIN, LIMIT_DAYS, LIMIT_DESTINATIONS,
    LIMIT_RECENT_ROWS, LIMIT_RECENT_TRIPS, LIMIT_ROUTES, LIMIT_STATIONS, LIMIT_TRAINS,
    LIMIT_TRIPS, MAX_STAT_DELAY,
)
from railpulse.functions.expr import (
    count_if, delay_probability, endpoint_or_unknown, hhmm, hour_label, non_empty, reliability_band,
    round1, safe_ratio, sum_if,
)
from railpulse.functions.ranges import TimeRange
from railpulse.functions.scope import ScopeFilter, bucket_condition, heuston_trip
from railpulse.operators.peaks import (
    LAST_ROW_FIELDS, PEAK_ROW_FIELDS, PeakSpec, filtered_snapshots, trip_peaks,
)
from railpulse.sources.tables import RailData

SCOPED = ScopeFilter.scopes()


def _cap_for(filt: ScopeFilter, cap):
    """Scoped variants always drop outliers; raw variants only if asked."""
    if cap == "auto":
        return MAX_STAT_DELAY if filt.is_scoped else None
    return cap


def _limit(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


# ---------------------------------------------------------------------------
# Dashboard (O-A13) and categories (O-A18)
# ---------------------------------------------------------------------------

def dashboard(data: RailData, window: TimeRange, filt: ScopeFilter = SCOPED,
              cap: int | None = MAX_STAT_DELAY, min_delay: int = DELAYED_MIN) -> DataFrame:
    tp = trip_peaks(data, PeakSpec(window=window, filt=filt, cap=cap))
    delayed = F.col("peak_delay") >= min_delay
    agg = tp.agg(
        F.coalesce(F.sum("snapshot_count"), F.lit(0)).cast("long").alias("total_snapshots"),
        F.count(F.lit(1)).alias("unique_trips"),
        F.coalesce(count_if(delayed), F.lit(0)).cast("long").alias("delayed_trips"),
        F.coalesce(sum_if(delayed, "peak_delay"), F.lit(0)).cast("long").alias("total_delay_minutes"),
        F.coalesce(F.max("peak_delay"), F.lit(0)).cast("int").alias("max_delay"),
    )
    return agg.select(
        "total_snapshots", "unique_trips", "delayed_trips",
        (F.col("unique_trips") - F.col("delayed_trips")).alias("on_time_trips"),
        "total_delay_minutes", "max_delay",
        round1(safe_ratio("total_delay_minutes", "delayed_trips")).alias("average_delay"),
        delay_probability("delayed_trips", "unique_trips").alias("delay_probability"),
    ).withColumn("reliability_band", reliability_band("delay_probability"))


def delay_categories(data: RailData, window: TimeRange, filt: ScopeFilter = SCOPED,
                     cap: int | None = MAX_STAT_DELAY) -> DataFrame:
    """Trips per delay category (On Time excluded), zero-filled, fixed order.

    Long form: one row per category with its ordinal and display label.
    """
    tp = trip_peaks(data, PeakSpec(window=window, filt=filt, cap=cap))
    cols = []
    for i, (name, lo, hi) in enumerate(CATEGORIES[1:], start=1):
        cond = (F.col("peak_delay") >= lo) if hi is None else F.col("peak_delay").between(lo, hi)
        cols.append(F.coalesce(count_if(cond), F.lit(0)).cast("long").alias(f"c{i}"))
    wide = tp.agg(*cols)
    stack = ", ".join(f"{i}, '{CATEGORY_LABELS[i]}', c{i}" for i in range(1, len(CATEGORIES)))
    return wide.selectExpr(f"stack({len(CATEGORIES) - 1}, {stack}) AS (ordinal, category, trips)") \
        .select(F.col("ordinal").cast("int"), "category", F.col("trips").cast("long"))


def peak_histogram(data: RailData, window: TimeRange, filt: ScopeFilter = SCOPED,
                   cap: int | None = MAX_STAT_DELAY) -> DataFrame:
    """Trips per category of their peak, On Time included (category dimension join)."""
    from railpulse.functions.expr import category_label, delay_category
    tp = trip_peaks(data, PeakSpec(window=window, filt=filt, cap=cap))
    return (tp.groupBy(delay_category("peak_delay").alias("category"))
            .agg(F.count(F.lit(1)).alias("trips"))
            .select("category", category_label("category").alias("label"), "trips"))


# ---------------------------------------------------------------------------
# Snapshot-grain hourly profile (O-A7)
# ---------------------------------------------------------------------------

def _scoped_sums(data: RailData, spec: PeakSpec, dims, measures) -> DataFrame:
    """Sum measures per dims over the selected snapshots (scope via buckets)."""
    s = filtered_snapshots(data, spec)
    s = s.withColumns({n: c for n, c in dims})
    dim_names = [n for n, _ in dims]
    filt = spec.filt
    if not filt.is_scoped or "resolved_scope" in s.columns:
        if filt.is_scoped:
            s = s.where(F.col("resolved_scope").isin(list(filt.scope_set)))
        return s.groupBy(*dim_names).agg(*[F.sum(c).alias(n) for n, c in measures])
    buckets = filt.buckets()
    s = s.where(F.col("service_scope").isNull() | F.col("service_scope").isin(list(filt.scope_set)))
    aggs = []
    for bk in buckets:
        cond = bucket_condition(bk)
        for n, c in measures:
            aggs.append(F.sum(F.when(cond, c)).alias(f"{n}_{bk}"))
    pre = s.groupBy("trip_id", *dim_names).agg(*aggs)
    trips = data.trips().select("trip_id", heuston_trip().alias("_heuston_trip"))
    j = pre.join(trips, "trip_id", "inner")
    sel = []
    for n, _ in measures:
        total = None
        for bk in buckets:
            term = F.when(filt.bucket_selected(bk, F.col("_heuston_trip")),
                          F.coalesce(F.col(f"{n}_{bk}"), F.lit(0))).otherwise(F.lit(0))
            total = term if total is None else total + term
        sel.append(total.alias(n))
    j = j.select(*dim_names, *sel)
    return j.groupBy(*dim_names).agg(*[F.sum(n).alias(n) for n, _ in measures]) \
        .where(F.col(measures[0][0]) > 0)


def hourly(data: RailData, window: TimeRange, filt: ScopeFilter = SCOPED, cap="auto",
           late_gt: int = 0) -> DataFrame:
    """Per hour of capture, by hour: snapshots, snapshots late > late_gt, their mean.

    Hours with no snapshots are absent (no zero fill), as in the reference.
    """
    spec = PeakSpec(window=window, filt=filt, cap=_cap_for(filt, cap))
    late = F.col("late_minutes") > late_gt
    sums = _scoped_sums(
        data, spec, [("hour", F.hour("captured_at"))],
        [("total", F.lit(1).cast("long")),
         ("delayed", F.when(late, F.lit(1)).otherwise(F.lit(0)).cast("long")),
         ("late_sum", F.when(late, F.col("late_minutes")).otherwise(F.lit(0)).cast("long"))])
    return sums.select(
        F.col("hour").cast("int").alias("hour"),
        hour_label("hour").alias("hour_label"),
        F.col("total").cast("long").alias("total"),
        F.col("delayed").cast("long").alias("delayed"),
        round1(safe_ratio("late_sum", "delayed")).alias("avg_delay"),
        delay_probability("delayed", "total").alias("delay_probability"),
    ).orderBy("hour")


# ---------------------------------------------------------------------------
# Largest delays (O-W1) and most recent delayed trips (O-W2)
# ---------------------------------------------------------------------------

TOP_TRIP_COLUMNS = ("train_code", "station_full_name", "train_date", "sch_depart", "sch_arrival",
                    "direction", "origin", "destination", "peak_delay", "snapshot_count",
                    "captured_at")


def _pick_rows(data: RailData, window, filt: ScopeFilter, cap, top: DataFrame, match,
               pick, min_late: int | None = None, limit: int = LIMIT_TRIPS) -> DataFrame:
    """Join the snapshots of the selection to the ``top`` trips and pick one
    row per trip.

    ``top`` is bounded by the report limit, so it is broadcast — once, with all
    its columns, so the first phase runs a single time.  ``match(cols)`` keeps
    the candidate rows, ``pick`` is the row-choosing aggregate.
    """
    s = filtered_snapshots(data, PeakSpec(window=window, filt=filt, cap=cap, min_late=min_late))
    top_cols = [c for c in top.columns if c != "trip_id"]
    snap_cols = [c for c in s.columns if c != "trip_id"]
    s = s.select("trip_id", *[F.col(c).alias(f"_s_{c}") for c in snap_cols])
    j = s.join(bounded(top, limit), "trip_id")
    if filt.is_scoped:
        if "_s_resolved_scope" in j.columns:
            j = j.where(F.col("_s_resolved_scope").isin(list(filt.scope_set)))
        else:
            j = j.where(filt.row_selected(F.col("_heuston_trip"), "_s_service_scope", "_s_station_code"))
    j = j.where(match)
    return j.groupBy("trip_id", *top_cols).agg(pick.alias("_row"))


def _bare(data: RailData, spec: PeakSpec) -> PeakSpec:
    """``spec`` without its trip join, where that would drop nothing."""
    return replace(spec, trip_cols=(), need_join=False) if data.trips_complete else spec


def _first_trips(data: RailData, spec: PeakSpec, order: list[Column], limit: int, where: Column | None = None) -> DataFrame:
    """The first ``limit`` rows of ``trip_peaks``; if all snapshots have their trip, only the first ones' are looked up."""
    bare = _bare(data, spec)
    tp = trip_peaks(data, bare)
    top = (tp if where is None else tp.where(where)).orderBy(*order).limit(limit)
    if bare is spec:
        return top
    # A trip may come more than once.
    return bounded(top, limit).join(data.trips().select("trip_id", *spec.trip_cols), "trip_id").orderBy(*order).limit(limit)


def top_delayed_trips(data: RailData, window: TimeRange, filt: ScopeFilter = SCOPED, cap="auto",
                      min_delay: int = DELAYED_MIN, limit: int = LIMIT_TRIPS,
                      peak_lookup: str = "auto") -> DataFrame:
    """Trips with the largest peak (>= min_delay) and the earliest snapshot at
    that peak (station, schedule, capture time as HH:mm).

    Two phases: peaks and counts are hash-aggregated per trip (fixed-width
    buffers), the top ``limit`` trips are taken, and only their snapshots are
    matched again to find the peak row.  ``peak_lookup="unfiltered"``
    reproduces the single-station variant whose lookup ignores the station
    filter (SURVEY Q8).
    """
    cap = _cap_for(filt, cap)
    if peak_lookup == "auto":
        peak_lookup = "unfiltered" if filt.kind == "station" else "filtered"
    trip_cols = ("train_code", "train_date", "direction", "origin", "destination")
    spec = PeakSpec(window=window, filt=filt, cap=cap, trip_cols=trip_cols, need_join=True)
    top = _first_trips(data, spec, [F.col("peak_delay").desc(), F.col("trip_id").asc()], limit, F.col("peak_delay") >= min_delay)
    lookup_filter = filt if peak_lookup == "filtered" else ScopeFilter.network()
    pick = F.min(F.struct(*[F.col(f"_s_{f}").alias(f) for f in PEAK_ROW_FIELDS]))
    rows = _pick_rows(data, window, lookup_filter, cap, top,
                      F.col("_s_late_minutes") == F.col("peak_delay"), pick, limit=limit)
    out = rows.select("*", *[F.col(f"_row.{f}").alias(f) for f in PEAK_ROW_FIELDS]).drop("_row")
    return out.select(
        "trip_id", "train_code", "station_full_name", "train_date", "sch_depart", "sch_arrival",
        "direction", "origin", "destination", F.col("peak_delay").cast("int").alias("peak_delay"),
        "snapshot_count", hhmm("captured_at").alias("captured_hhmm"),
    ).orderBy(F.col("peak_delay").desc(), F.col("trip_id").asc()).drop("trip_id")


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """``df`` of at most ``limit`` rows, broadcast if these are few."""
    return F.broadcast(df) if limit <= BROADCAST_LIMIT else df


def newest_window(data: RailData, candidates: Callable[[TimeRange], DataFrame], limit: int) -> TimeRange | None:
    """The end of the history that holds the ``limit`` newest candidates; None if that is all of it.

    Windows of 1, 4, 16 … days back from the newest service date are read until ``candidates`` of one are enough.
    What is not read is older than all of the window, so none of the newest is missed.  Where candidates are rare
    the work is a third more than one pass.
    """
    days = data.first_and_last_day()
    if days is None:
        return None
    end = dt.datetime.combine(days[1] + dt.timedelta(days=1), dt.time())
    n = 1
    while True:
        start = days[1] - dt.timedelta(days=n - 1)
        if start <= days[0]:
            return None
        window = TimeRange(dt.datetime.combine(start, dt.time()), end)
        if candidates(window).limit(limit).count() >= limit:
            return window
        n *= 4


def recent_delayed_trips(data: RailData, filt: ScopeFilter = SCOPED, cap="auto",
                         min_delay: int = DELAYED_MIN, limit: int = LIMIT_RECENT_TRIPS,
                         keep_captured_at: bool = False) -> DataFrame:
    """Latest delayed snapshot of each trip, the ``limit`` newest trips.

    No date window (the reference ignores it here, SURVEY Q14): the history
    is read from its newest end, as far as it takes.  Phase one
    hash-aggregates each trip's latest delayed capture time; phase two reads
    the rows of the ``limit`` chosen trips at that instant and breaks ties.
    """
    cap = _cap_for(filt, cap)

    def latest(window: TimeRange | None) -> PeakSpec:
        return PeakSpec(window=window, filt=filt, cap=cap, min_late=min_delay,
                        extra_max=(("last_seen", F.col("captured_at")),),
                        trip_cols=("train_code", "origin", "destination"), need_join=True)

    window = newest_window(data, lambda w: trip_peaks(data, _bare(data, latest(w))), limit)
    top = _first_trips(data, latest(window), [F.col("last_seen").desc(), F.col("trip_id").asc()], limit)
    pick = F.max(F.struct(*[F.col(f"_s_{c}").alias(c) for c in LAST_ROW_FIELDS]))
    rows = _pick_rows(data, window, filt, cap, top, F.col("_s_captured_at") == F.col("last_seen"), pick,
                      min_late=min_delay, limit=limit)
    out = rows.select("trip_id", "train_code", "origin", "destination",
                      F.col("_row.captured_at").alias("captured_at"),
                      F.col("_row.station_full_name").alias("station_full_name"),
                      F.col("_row.late_minutes").cast("int").alias("late_minutes"))
    out = out.select("train_code", "station_full_name", "late_minutes",
                     hhmm("captured_at").alias("captured_hhmm"), "origin", "destination",
                     "captured_at", "trip_id") \
        .orderBy(F.col("captured_at").desc(), F.col("trip_id").asc()).drop("trip_id")
    return out if keep_captured_at else out.drop("captured_at")


def recent_delay_rows(data: RailData, min_exclusive: int = DELAYED_MIN - 1,
                      cap: int | None = MAX_STAT_DELAY, limit: int = LIMIT_RECENT_ROWS,
                      nested: bool = True) -> DataFrame:
    """The ``limit`` newest snapshots with min_exclusive < late <= cap, each
    with its trip nested (O-L3).  The history is read from its newest end."""
    def late(window: TimeRange | None) -> DataFrame:
        s = data.snapshots(window).where(F.col("late_minutes") > min_exclusive)
        return s if cap is None else s.where(F.col("late_minutes") <= cap)

    order = [F.col("captured_at").desc(), F.col("trip_id").asc(), F.col("station_code").asc(),
             F.col("sch_depart").asc(), F.col("late_minutes").asc()]
    top = late(newest_window(data, late, limit)).select(
        "trip_id", "station_code", "station_full_name", "sch_depart", "late_minutes", "captured_at").orderBy(*order).limit(limit)
    # ``top`` holds at most ``limit`` rows: the trip lookup joins against a
    # bounded frame.
    trips = data.trips()
    nested_df = top.join(
        trips.join(bounded(top.select("trip_id").distinct(), limit), "trip_id", "left_semi"),
        "trip_id", "left")
    trip_fields = ("train_code", "train_date", "train_type", "origin", "destination", "direction")
    base = ("trip_id", "station_code", "station_full_name", "sch_depart", "late_minutes", "captured_at")
    if not nested:
        return nested_df.select(*base, *trip_fields).orderBy(*order)
    return nested_df.select(*base, F.struct(*trip_fields).alias("trip")).orderBy(*order)


# ---------------------------------------------------------------------------
# Destination and route rankings (O-A8/A9, O-A16/A17)
# ---------------------------------------------------------------------------

def _endpoint_exprs(names, missing: str):
    if missing == "unknown":
        return tuple((n, endpoint_or_unknown(n)) for n in names)
    return tuple((n, F.col(n)) for n in names)


def _ranked_endpoints(data, window, filt, cap, min_delay, names, missing):
    spec = PeakSpec(window=window, filt=filt, cap=cap, trip_exprs=_endpoint_exprs(names, missing))
    tp = trip_peaks(data, spec)
    if missing == "drop":
        for n in names:
            tp = tp.where(non_empty(n))
    delayed = F.col("peak_delay") >= min_delay
    return tp.groupBy(*names).agg(
        F.count(F.lit(1)).alias("total_trips"),
        count_if(delayed).alias("delayed_trips"),
        sum_if(delayed, "peak_delay").alias("total_delay_minutes"),
    ).where(F.col("delayed_trips") > 0).withColumn(
        "_avg", safe_ratio("total_delay_minutes", "delayed_trips"))


def destinations(data: RailData, window: TimeRange, filt: ScopeFilter = SCOPED, cap="auto",
                 min_delay: int = DELAYED_MIN, limit: int | None = LIMIT_DESTINATIONS,
                 missing: str = "auto") -> DataFrame:
    """Destinations by average peak of delayed trips (HAVING delayed > 0).

    Scoped form maps NULL/'' to 'Unknown'; raw form drops them (SURVEY Q7).
    """
    if missing == "auto":
        missing = "unknown" if filt.is_scoped else "drop"
    r = _ranked_endpoints(data, window, filt, _cap_for(filt, cap), min_delay, ("destination",), missing)
    r = r.orderBy(F.col("_avg").desc(), F.col("destination").asc())
    return _limit(r, limit).select(
        "destination", "total_trips", "delayed_trips", "total_delay_minutes",
        round1("_avg").alias("average_delay"),
        delay_probability("delayed_trips", "total_trips").alias("delay_probability"),
        "_avg").orderBy(F.col("_avg").desc(), F.col("destination").asc()).drop("_avg")


def routes(data: RailData, window: TimeRange, filt: ScopeFilter = SCOPED, cap="auto",
           min_delay: int = DELAYED_MIN, limit: int | None = LIMIT_ROUTES,
           missing: str = "auto") -> DataFrame:
    """(origin, destination) pairs by accumulated peak delay of delayed trips."""
    if missing == "auto":
        missing = "unknown" if filt.is_scoped else "drop"
    r = _ranked_endpoints(data, window, filt, _cap_for(filt, cap), min_delay,
                          ("origin", "destination"), missing)
    order = [F.col("total_delay_minutes").desc(), F.col("origin").asc(), F.col("destination").asc()]
    return _limit(r.orderBy(*order), limit).select(
        "origin", "destination", "total_trips", "delayed_trips", "total_delay_minutes",
        round1("_avg").alias("average_delay"),
        delay_probability("delayed_trips", "total_trips").alias("delay_probability"),
    ).withColumn("reliability_band", reliability_band("delay_probability")).orderBy(*order)


# ---------------------------------------------------------------------------
# Daily delayed trips (O-A11) and train ranking (O-A12)
# ---------------------------------------------------------------------------

def daily_delays(data: RailData, window: TimeRange, cap: int | None = MAX_STAT_DELAY,
                 min_delay: int = DELAYED_MIN, limit: int | None = LIMIT_DAYS) -> DataFrame:
    """Delayed trips per train_date, newest first sighting first."""
    spec = PeakSpec(window=window, cap=cap, first_seen=True, trip_cols=("train_date",))
    tp = trip_peaks(data, spec).where(non_empty("train_date") & (F.col("peak_delay") >= min_delay))
    days = tp.groupBy("train_date").agg(F.count(F.lit(1)).alias("delayed_trip_count"),
                                        F.min("first_seen").alias("date_seen"))
    order = [F.col("date_seen").desc(), F.col("train_date").asc()]
    return _limit(days.orderBy(*order), limit).orderBy(*order)


def top_trains(data: RailData, cap: int | None = MAX_STAT_DELAY, min_delay: int = DELAYED_MIN,
               limit: int | None = LIMIT_TRAINS) -> DataFrame:
    """Train codes by delayed trips over all time, then average peak."""
    spec = PeakSpec(window=None, cap=cap, trip_cols=("train_code",))
    tp = trip_peaks(data, spec)
    delayed = F.col("peak_delay") >= min_delay
    r = tp.groupBy("train_code").agg(
        count_if(delayed).alias("delayed_trips"),
        F.avg(F.when(delayed, F.col("peak_delay").cast("double"))).alias("_avg"),
        F.max("peak_delay").cast("int").alias("max_delay"),
    ).withColumn("_avg", F.coalesce("_avg", F.lit(0.0)))
    order = [F.col("delayed_trips").desc(), F.col("_avg").desc(), F.col("train_code").asc()]
    return _limit(r.orderBy(*order), limit).select(
        "train_code", "delayed_trips", round1("_avg").alias("average_delay"), "max_delay", "_avg"
    ).orderBy(*order).drop("_avg")


# ---------------------------------------------------------------------------
# Raw counters (O-A1..A5, O-A10) and raw station statistics (O-A6)
# ---------------------------------------------------------------------------

def snapshot_count(data: RailData, window: TimeRange, filt: ScopeFilter = ScopeFilter.network()) -> DataFrame:
    s = filtered_snapshots(data, PeakSpec(window=window, filt=filt))
    return s.agg(F.count(F.lit(1)).alias("snapshots"))


def max_delay(data: RailData, window: TimeRange, filt: ScopeFilter = ScopeFilter.network()) -> DataFrame:
    """Max lateness of any snapshot; NULL when the window is empty, no cap."""
    s = filtered_snapshots(data, PeakSpec(window=window, filt=filt))
    return s.agg(F.max("late_minutes").alias("max_delay"))


def unique_trips(data: RailData, window: TimeRange, filt: ScopeFilter = ScopeFilter.network()) -> DataFrame:
    tp = trip_peaks(data, PeakSpec(window=window, filt=filt))
    return tp.agg(F.count(F.lit(1)).alias("unique_trips"))


def delayed_trips(data: RailData, window: TimeRange, filt: ScopeFilter = ScopeFilter.network(),
                  min_delay: int = DELAYED_MIN) -> DataFrame:
    tp = trip_peaks(data, PeakSpec(window=window, filt=filt))
    return tp.agg(count_if(F.col("peak_delay") >= min_delay).alias("delayed_trips")) \
        .select(F.coalesce("delayed_trips", F.lit(0)).cast("long").alias("delayed_trips"))


def avg_peak_delay(data: RailData, window: TimeRange, filt: ScopeFilter = ScopeFilter.network(),
                   min_delay: int = DELAYED_MIN) -> DataFrame:
    tp = trip_peaks(data, PeakSpec(window=window, filt=filt)).where(F.col("peak_delay") >= min_delay)
    return tp.agg(F.coalesce(F.avg(F.col("peak_delay").cast("double")), F.lit(0.0)).alias("avg_peak_delay"))


def peak_delays(data: RailData, window: TimeRange, filt: ScopeFilter = ScopeFilter.network(),
                min_delay: int = DELAYED_MIN) -> DataFrame:
    """One row per delayed trip with its peak (no order)."""
    tp = trip_peaks(data, PeakSpec(window=window, filt=filt))
    return tp.where(F.col("peak_delay") >= min_delay).select(F.col("peak_delay").cast("int"))


def station_stats(data: RailData, window: TimeRange, filt: ScopeFilter = ScopeFilter.network(),
                  min_delay: int = DELAYED_MIN, limit: int | None = LIMIT_STATIONS) -> DataFrame:
    """Per raw (station_code, station_full_name): trips, delayed trips, mean
    peak of the delayed ones, accumulated delay; most delayed first."""
    spec = PeakSpec(window=window, filt=filt,
                    dims=(("station_code", F.col("station_code")),
                          ("station_full_name", F.col("station_full_name"))))
    tp = trip_peaks(data, spec)
    delayed = F.col("peak_delay") >= min_delay
    r = tp.groupBy("station_code", "station_full_name").agg(
        F.count(F.lit(1)).alias("total_trips"),
        count_if(delayed).alias("delayed_trips"),
        sum_if(delayed, "peak_delay").alias("total_delay_minutes"),
    ).withColumn("_avg", safe_ratio("total_delay_minutes", "delayed_trips"))
    order = [F.col("delayed_trips").desc(), F.col("_avg").desc(), F.col("station_code").asc(),
             F.col("station_full_name").asc()]
    return _limit(r.orderBy(*order), limit).select(
        "station_code", "station_full_name", "total_trips", "delayed_trips",
        round1("_avg").alias("average_delay"),
        delay_probability("delayed_trips", "total_trips").alias("delay_probability"),
        "total_delay_minutes", "_avg").withColumn("reliability_band", reliability_band("delay_probability")) \
        .orderBy(*order).drop("_avg")
