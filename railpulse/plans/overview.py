"""Composite views: the analytics overview bundle (O-B1), the station page
(O-B2), its JSON document (O-S14) and the summary shapes (O-A21).

``materialised`` reads snapshots and trips once, resolves each snapshot's scope and
writes both in the shared folder; a bundle's parts all read that.
``overview`` returns a dict of lazy DataFrames.  ``overview_rows`` gives them in one
long table (section, ordinal, field, value).  ``overview_document`` folds the parts into a single row of arrays in the
reports' own order; every part is bounded (fixed limits, 24 hours, one row
per station), so collecting each into an array is bounded too.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railpulse.functions.constants import DELAYED_MIN, LIMIT_STATIONS, MAX_STAT_DELAY
from railpulse.functions.expr import count_if, delay_category, round1
from railpulse.functions.ranges import TimeRange
from railpulse.functions.scope import ScopeFilter, heuston_trip, resolve_scope, scope_from_code
from railpulse.operators import metrics as M
from railpulse.operators import reports as R
from railpulse.operators.live import board_counts, live_board
from railpulse.session import ensure_checkpoint_dir
from railpulse.sources.tables import FrameData, RailData, few


# What the parts of a bundle read of a snapshot, beside its resolved scope; the others would only be written and shuffled.
SNAPSHOT_PARTS = ("trip_id", "station_code", "station_full_name", "sch_depart", "sch_arrival", "late_minutes", "captured_at")


class Written(FrameData):
    """Snapshots and trips as ``materialised`` wrote them, with the numbered station names."""

    def __init__(self, spark: SparkSession, snapshots: DataFrame, trips: DataFrame, trips_complete: bool):
        super().__init__(spark, snapshots, trips)
        self.trips_complete = trips_complete
        self.names = few(M.numbered(snapshots.select("station_full_name").distinct()))


def materialised(data: RailData) -> Written:
    """All snapshots up to the outlier cap with their resolved scope, and all trips, written once.

    Reports take ``resolved_scope`` as a plain filter, so no part of a bundle scans the history or joins it with
    the trips again to find a scope.
    """
    ensure_checkpoint_dir(data.spark)
    trips = data.trips().checkpoint(eager=True)
    snaps = data.snapshots().where(F.col("late_minutes") <= MAX_STAT_DELAY)
    joined = "resolved_scope" not in snaps.columns
    if joined:
        # AQE splits a trip with very many snapshots
        snaps = snaps.join(trips.select("trip_id", heuston_trip().alias("_heuston_trip")), "trip_id").withColumn(
            "resolved_scope", resolve_scope(related=F.col("_heuston_trip")))
    return Written(data.spark, snaps.select(*SNAPSHOT_PARTS, "resolved_scope").checkpoint(eager=True), trips, joined)


def overview(data: RailData, window: TimeRange, station_code: str | None = None,
             metrics: DataFrame | None = None, rank_limit: int | None = None,
             with_routes: bool = True, aggregate_window: TimeRange | None = None) -> dict[str, DataFrame]:
    """The analytics bundle for the network or one scope's overview code.

    ``window`` bounds the hourly profile and the largest delays, ``aggregate_window`` the other parts; the two differ
    where the end is open (SURVEY Q2).  Without the second both are the same.
    """
    has_scope = scope_from_code(station_code) is not None
    filt = ScopeFilter.scope(station_code) if has_scope else ScopeFilter.scopes()
    if metrics is None:
        metrics = M.build_daily_metrics(data, with_updated_at=False, names=getattr(data, "names", None))
    aggregate = aggregate_window or window
    parts = {
        "dashboard": R.dashboard(data, aggregate, filt),
        "stationRank": M.station_ranking(metrics, aggregate, filt, rank_limit),
        "hourly": R.hourly(data, window, filt),
        "top10Delays": R.top_delayed_trips(data, window, filt),
        "recentDelays": R.recent_delayed_trips(data, filt, keep_captured_at=True),
        "destinations": R.destinations(data, aggregate, filt),
        "categories": R.delay_categories(data, aggregate, filt),
    }
    if with_routes:
        parts["routeRanking"] = R.routes(data, aggregate, filt)
    return parts


def windows(period: str | None, from_date=None, to_date=None, as_of: dt.datetime | None = None) -> dict[str, TimeRange]:
    """Both windows of a bundle for a period or dates as a caller gives them."""
    return {"window": TimeRange.period(period, from_date, to_date, as_of=as_of, open_end="instant"),
            "aggregate_window": TimeRange.period(period, from_date, to_date, as_of=as_of, open_end="midnight")}


def station_page(data: RailData, payloads: DataFrame, station_code: str, window: TimeRange,
                 metrics: DataFrame | None = None) -> dict[str, DataFrame]:
    """O-B2: one station's live board plus network analytics (top-15 rank, no routes)."""
    parts = overview(data, window, None, metrics, rank_limit=LIMIT_STATIONS, with_routes=False)
    # The board is requested by its code as given (the API is keyed by it).
    board = live_board(payloads).where(F.col("board_station") == station_code.strip())
    parts["board"] = board
    parts["boardCounts"] = board_counts(board)
    return parts


def _ordered(df: DataFrame, name: str) -> DataFrame:
    """The rows of an ordered report as one array, in that order."""
    payload = F.struct(*[F.col(c) for c in df.columns])
    # Increases along the sorted partitions, so it carries the report's order into the array.
    e = F.struct(F.monotonically_increasing_id().alias("k"), payload.alias("v"))
    return df.select(e.alias("e")).agg(F.array_sort(F.collect_list("e")).alias("a")) \
        .select(F.transform("a", lambda x: x["v"]).alias(name), F.lit(1).alias("_k"))


#: Parts with a fixed order of their own; the others come ordered.
PART_ORDER = {"categories": ["ordinal"], "board": ["train_code", "station_code", "late_minutes", "due_in", "origin", "destination"]}


def _long(df: DataFrame, section: str) -> DataFrame:
    """(section, ordinal, field, value) of an ordered report; numbers with a fraction have one decimal."""
    if section in PART_ORDER:
        df = df.orderBy(*PART_ORDER[section])
    kinds = dict(df.dtypes)
    fields = [c for c in df.columns if not kinds[c].startswith("timestamp") and c != "ordinal"]
    value = lambda c: F.format_string("%.1f", F.col(c)) if kinds[c] == "double" else F.col(c).cast("string")
    # a report is bounded: hours, stations or its limit
    ranked = df.withColumn("_place", F.monotonically_increasing_id()).withColumn(
        "ordinal", F.row_number().over(Window.orderBy("_place")).cast("long"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), value(c).alias("value")) for c in fields])).alias("cell")
    return ranked.select(F.lit(section).alias("section"), "ordinal", cells).select("section", "ordinal", "cell.field", "cell.value")


def overview_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """A bundle as one long table, with the category counters (O-A20) as a section of their own."""
    out = None
    for section, df in parts.items():
        rows = _long(df, section)
        out = rows if out is None else out.unionByName(rows)
    names = ("catSmall", "catMedium", "catBig", "catExtreme")
    counts = parts["categories"].agg(
        F.coalesce(F.max("trips"), F.lit(1)).alias("maxCatCount"),
        *[F.max(F.when(F.col("ordinal") == i + 1, F.col("trips"))).alias(n) for i, n in enumerate(names)])
    extras = _long(counts, "extras").unionByName(_long(parts["dashboard"].select(F.col("on_time_trips").alias("catOnTime")), "extras"))
    return out.unionByName(extras)


def overview_document(parts: dict[str, DataFrame]) -> DataFrame:
    """One row: every part as an ordered array, the chart arrays, the category
    map and counters, and the whole document as JSON."""
    d = parts["dashboard"].withColumn("_k", F.lit(1))
    frames = [d.select(F.struct(*[c for c in d.columns if c != "_k"]).alias("dashboard"), "_k")]
    for name in ("stationRank", "hourly", "top10Delays", "recentDelays", "destinations"):
        frames.append(_ordered(parts[name], name))
    frames.append(_ordered(parts["categories"].orderBy("ordinal"), "categories"))
    if "routeRanking" in parts:
        frames.append(_ordered(parts["routeRanking"], "routeRanking"))
    doc = frames[0]
    for f in frames[1:]:
        doc = doc.join(f, "_k")   # single-row frames joined on a constant key
    cats = F.col("categories")
    doc = doc.select(
        "*",
        F.transform("hourly", lambda h: h["hour_label"]).alias("hourlyLabels"),
        F.transform("hourly", lambda h: h["delay_probability"]).alias("hourlyDelayPcts"),
        F.transform("hourly", lambda h: h["avg_delay"]).alias("hourlyAvgDelays"),
        F.transform("destinations", lambda x: x["destination"]).alias("destLabels"),
        F.transform("destinations", lambda x: x["average_delay"]).alias("destAvgDelays"),
        F.transform("destinations", lambda x: x["delayed_trips"]).alias("destDelayCounts"),
        F.map_from_entries(F.transform(cats, lambda c: F.struct(c["category"], c["trips"]))).alias("categoryMap"),
        F.coalesce(F.array_max(F.transform(cats, lambda c: c["trips"])), F.lit(1)).alias("maxCatCount"),
        F.col("dashboard.on_time_trips").alias("catOnTime"),
        *[F.element_at(cats, i + 1)["trips"].alias(n) for i, n in
          enumerate(("catSmall", "catMedium", "catBig", "catExtreme"))],
    ).drop("_k")
    return doc.withColumn("json", F.to_json(F.struct(*[c for c in doc.columns])))


# ---------------------------------------------------------------------------
# Summary shapes (O-A21): value classes without a builder in the reference;
# semantics here: snapshot grain, outliers capped, delayed = late >= 5.
# ---------------------------------------------------------------------------

def analytics_summary(data: RailData, window: TimeRange, cap: int | None = MAX_STAT_DELAY,
                      min_delay: int = DELAYED_MIN) -> DataFrame:
    s = data.snapshots(window)
    if cap is not None:
        s = s.where(F.col("late_minutes") <= cap)
    delayed = F.col("late_minutes") >= min_delay
    totals = s.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.coalesce(count_if(delayed), F.lit(0)).cast("long").alias("total_delays"),
        round1(F.coalesce(F.avg(F.when(delayed, F.col("late_minutes").cast("double"))), F.lit(0.0)))
        .alias("avg_delay_minutes"),
        *[F.coalesce(count_if(delay_category("late_minutes") == n), F.lit(0)).cast("long").alias(a)
          for n, a in (("On Time", "on_time"), ("Small Delay", "small"), ("Medium Delay", "medium"),
                       ("Big Delay", "big"), ("Extreme Delay", "extreme"))],
    ).withColumn("_k", F.lit(1))

    def worst(col: str, name: str) -> DataFrame:
        per = s.where(delayed).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
        return per.agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(col).alias("v"))).alias("w")) \
            .select(F.col("w.v").alias(name), F.lit(1).alias("_k"))

    trips = data.trips().select("trip_id", "train_code")
    s_t = s.join(trips, "trip_id")
    per_train = s_t.where(delayed).groupBy("train_code").agg(F.count(F.lit(1)).alias("n"))
    w_train = per_train.agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("train_code").alias("v"))).alias("w")) \
        .select(F.col("w.v").alias("most_delayed_train"), F.lit(1).alias("_k"))
    out = totals.join(worst("station_code", "most_delayed_station"), "_k", "left") \
        .join(w_train, "_k", "left").drop("_k")
    return out


def station_delay_summary(data: RailData, window: TimeRange, cap: int | None = MAX_STAT_DELAY,
                          min_delay: int = DELAYED_MIN) -> DataFrame:
    s = data.snapshots(window)
    if cap is not None:
        s = s.where(F.col("late_minutes") <= cap)
    d = s.where(F.col("late_minutes") >= min_delay)
    return d.groupBy("station_code").agg(
        F.max("station_full_name").alias("station_name"),
        F.count(F.lit(1)).alias("delay_count"),
        round1(F.avg(F.col("late_minutes").cast("double"))).alias("avg_delay_minutes"),
        F.max("late_minutes").alias("max_delay_minutes"),
    )
