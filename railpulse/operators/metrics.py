"""Daily station-and-route metrics (O-A14) and the rankings read from them.

Grain: (service_date, service_scope, UPPER(station_code), origin, destination),
with endpoints mapped NULL/'' -> 'Unknown'.  A trip counts once per grain row
("trip-days"): summing ``unique_trips`` over dates or stations counts a trip
more than once (SURVEY Q4), exactly as the reference's ranking does.

The rows are built from *states*: snapshot count and peak of each trip within a
row and station name.  States of parts of the snapshots add up to those of the
whole, so :mod:`railpulse.operators.metrics_table` keeps them beside the metrics.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse.functions.constants import (
    ALL_SCOPES, CATEGORIES, DELAYED_MIN, MAX_STAT_DELAY,
)
from railpulse.functions.expr import count_if, delay_probability, endpoint_or_unknown, reliability_band, round1, safe_ratio, sum_if
from railpulse.functions.ranges import TimeRange
from railpulse.functions.scope import ScopeFilter, heuston_trip, is_heuston_station
from railpulse.operators.peaks import PeakSpec, filtered_snapshots
from railpulse.sources.tables import RailData

METRIC_COLUMNS = (
    "service_date", "service_scope", "station_code", "station_full_name", "origin", "destination",
    "total_snapshots", "unique_trips", "delayed_trips", "on_time_trips", "average_delay_minutes",
    "max_delay_minutes", "total_delay_minutes", "small_delay_trips", "medium_delay_trips",
    "big_delay_trips", "extreme_delay_trips",
)


def trip_states(data: RailData, window: TimeRange | None = None, cap: int | None = MAX_STAT_DELAY) -> DataFrame:
    """(service_date, scope, station, origin, destination, trip, name) with
    snapshot count and peak.

    Snapshots are reduced per (trip, date, station, name, scope known without
    the trip) before the trip join — all aggregation buffers are fixed-width, so this is
    a hash aggregate with map-side combine; the station name is a grouping key
    rather than a ``max`` buffer.  A NULL scope away from HSTON then resolves
    with the trip's Heuston flag.
    """
    s = filtered_snapshots(data, PeakSpec(window=window, cap=cap))
    base = [F.col("trip_id"), F.to_date("captured_at").alias("service_date"),
            F.upper("station_code").alias("station_code"), F.col("station_full_name"), F.col("late_minutes")]
    trips_cols = [endpoint_or_unknown("origin").alias("origin"),
                  endpoint_or_unknown("destination").alias("destination")]
    if "resolved_scope" in s.columns:
        s = s.select(*base, F.col("resolved_scope").alias("service_scope"))
        pre = s.groupBy("trip_id", "service_date", "service_scope", "station_code", "station_full_name").agg(
            F.count(F.lit(1)).alias("n"), F.max("late_minutes").alias("p"))
        return pre.join(data.trips().select("trip_id", *trips_cols), "trip_id")
    # Resolved without the trip: explicit scopes keep their value, NULL at
    # HSTON is HEUSTON; NULL elsewhere ("_u") waits for the trip's flag.
    sc = F.col("service_scope")
    known = F.when(sc.isNull() & is_heuston_station("station_code"), F.lit("HEUSTON")).otherwise(sc)
    s = s.select(*base, known.alias("_known"))
    pre = s.groupBy("trip_id", "service_date", "_known", "station_code", "station_full_name").agg(
        F.count(F.lit(1)).alias("n"), F.max("late_minutes").alias("p"))
    trips = data.trips().select("trip_id", heuston_trip().alias("_heuston_trip"), *trips_cols)
    return pre.join(trips, "trip_id").select(
        "trip_id", "service_date", "station_code", "station_full_name", "origin", "destination", "n", "p",
        F.coalesce(F.col("_known"),
                   F.when(F.col("_heuston_trip"), F.lit("HEUSTON")).otherwise(F.lit("CONNOLLY")))
        .alias("service_scope"))


GRAIN = ("service_date", "service_scope", "station_code", "origin", "destination")


def build_daily_metrics(data: RailData, window: TimeRange | None = None,
                        cap: int | None = MAX_STAT_DELAY, min_delay: int = DELAYED_MIN,
                        with_updated_at: bool = True, names: DataFrame | None = None) -> DataFrame:
    """The metrics rows for all snapshots (or those inside ``window``)."""
    return metrics_from_states(trip_states(data, window, cap), min_delay, with_updated_at, names)


def numbered(names: DataFrame) -> DataFrame:
    """Distinct station names with their numbers in order.  One row each, numbered in one task."""
    return names.select("station_full_name", F.row_number().over(Window.orderBy("station_full_name")).alias("_name"))


def metrics_from_states(rows: DataFrame, min_delay: int = DELAYED_MIN, with_updated_at: bool = True,
                        names: DataFrame | None = None) -> DataFrame:
    """Metrics rows of states, of which a trip may have several in a row.

    All buffers are fixed-width, so that every step is a hash aggregate: the largest station name of a row is found
    as the largest number in the order of the distinct names.  ``names`` are these, ``numbered``, of at least the
    states, where the caller knows them.
    """
    if names is None:
        # The distinct names read the same columns as the measures, so that Spark shuffles the snapshots once for both.
        names = numbered(rows.groupBy("station_full_name").agg(F.sum("n").alias("_n"), F.max("p").alias("_p"))
                         .where((F.col("_n") > 0) & (F.col("_p").isNotNull() | (F.col("_n") < 2 ** 62))))
    tp = rows.join(names, "station_full_name", "left").groupBy(*GRAIN, "trip_id").agg(
        F.sum("n").cast("long").alias("snapshot_count"), F.max("p").alias("peak_delay"), F.max("_name").alias("_name"))
    peak = F.col("peak_delay")
    delayed = peak >= min_delay
    cats = []
    for name, lo, hi in CATEGORIES[1:]:
        cond = (peak >= lo) if hi is None else peak.between(lo, hi)
        col = name.split()[0].lower() + "_delay_trips"
        cats.append(count_if(cond).alias(col))
    m = tp.groupBy(*GRAIN).agg(
        F.sum("snapshot_count").cast("long").alias("total_snapshots"),
        F.count(F.lit(1)).alias("unique_trips"),
        count_if(delayed).alias("delayed_trips"),
        count_if(peak < min_delay).alias("on_time_trips"),
        F.coalesce(F.avg(F.when(delayed, peak.cast("double"))), F.lit(0.0)).alias("average_delay_minutes"),
        F.coalesce(F.max(peak), F.lit(0)).cast("int").alias("max_delay_minutes"),
        sum_if(delayed, "peak_delay").alias("total_delay_minutes"),
        *cats, F.max("_name").alias("_name"),
    ).join(names, "_name", "left")
    cols = list(METRIC_COLUMNS)
    if with_updated_at:
        m = m.withColumn("updated_at", F.current_timestamp())
        cols.append("updated_at")
    return m.select(*cols)


def metrics_retained(metrics: DataFrame, cutoff: dt.date) -> DataFrame:
    """O-S9 as a query: the rows a retention run keeps."""
    return metrics.where(F.col("service_date") >= F.lit(cutoff.isoformat()).cast("date"))


# ---------------------------------------------------------------------------
# Station ranking (O-A15)
# ---------------------------------------------------------------------------

def station_ranking(metrics: DataFrame, window: TimeRange, filt: ScopeFilter = ScopeFilter.scopes(),
                    limit: int | None = None) -> DataFrame:
    """Roll daily metrics up per station: trip-days, delayed trip-days, total
    delay; most delayed first, then by delay per delayed trip."""
    scopes = list(filt.scope_set) if filt.is_scoped else list(ALL_SCOPES)
    m = metrics.where((F.col("service_date") >= F.lit(window.start_date.isoformat()).cast("date"))
                      & (F.col("service_date") < F.lit(window.end_date_exclusive.isoformat()).cast("date"))
                      & F.col("service_scope").isin(scopes))
    r = m.groupBy("station_code").agg(
        F.max("station_full_name").alias("station_full_name"),
        F.coalesce(F.sum("unique_trips"), F.lit(0)).cast("long").alias("total_trips"),
        F.coalesce(F.sum("delayed_trips"), F.lit(0)).cast("long").alias("delayed_trips"),
        F.coalesce(F.sum("total_delay_minutes"), F.lit(0)).cast("long").alias("total_delay_minutes"),
    ).withColumn("_ratio", safe_ratio("total_delay_minutes", "delayed_trips"))
    order = [F.col("delayed_trips").desc(), F.col("_ratio").desc(), F.col("station_code").asc()]
    r = r.orderBy(*order)
    if limit is not None:
        r = r.limit(limit)
    return r.select(
        "station_code", "station_full_name", "total_trips", "delayed_trips",
        round1("_ratio").alias("average_delay"),
        delay_probability("delayed_trips", "total_trips").alias("delay_probability"),
        "total_delay_minutes", "_ratio").withColumn("reliability_band", reliability_band("delay_probability")) \
        .orderBy(*order).drop("_ratio")

