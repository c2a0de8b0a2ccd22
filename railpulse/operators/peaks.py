"""Trip-grain peaks: the shared first level of almost every report.

``trip_peaks`` reduces the snapshots of a window to one row per trip (or per
trip and extra snapshot-side dimensions) with

* ``snapshot_count`` – rows read,
* ``peak_delay``     – max lateness,
* optionally ``first_seen`` (min captured_at), the *peak row* (earliest
  snapshot at the peak) and the *last delayed row*.

Plan shape, chosen for scale:

1. filter + project the snapshot scan (window, outlier cap and station list
   reach the Parquet reader);
2. aggregate per (trip_id, dims) **before** the join: the partial aggregate
   runs map-side, so a trip or station holding a third of all rows is already
   collapsed to one row per task before the shuffle, and the join input is
   trip-grain;
3. join the trip dimension on ``trip_id`` only when the report needs trip
   columns or the scope fallback;
4. for scoped reports, combine the three pre-join scope buckets (see
   ``railpulse.functions.scope``) with plain column arithmetic.

Row picks use ``min`` over a struct whose leading fields are the ordering
(``-late, captured_at, …``), which is an ordinary mergeable aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.functions.ranges import TimeRange
from railpulse.functions.scope import ScopeFilter, bucket_condition, heuston_trip
from railpulse.sources.tables import RailData

# Fields of the peak row: ordering first, then the values reported.
PEAK_ROW_FIELDS = ("captured_at", "station_full_name", "sch_depart", "sch_arrival", "station_code")
# Fields of the last delayed row (ordered by captured_at descending).
LAST_ROW_FIELDS = ("captured_at", "station_full_name", "late_minutes", "station_code", "sch_depart")


@dataclass
class PeakSpec:
    """What the trip-grain aggregate must carry."""

    window: TimeRange | None = None
    filt: ScopeFilter = field(default_factory=ScopeFilter.network)
    cap: int | None = None
    dims: tuple = ()                # snapshot-side grouping columns (name -> Column)
    trip_cols: tuple[str, ...] = ()  # trip columns to carry (trip-functional)
    trip_exprs: tuple = ()          # (name, Column over trip columns)
    first_seen: bool = False
    min_late: int | None = None      # extra snapshot filter late >= this
    extra_max: tuple = ()            # (name, Column) extra max() aggregates
    need_join: bool = False          # force the trip join (inner-join semantics)


def _base_aggs(spec: PeakSpec, cond: Column | None, sfx: str) -> list[Column]:
    def w(v):
        return v if cond is None else F.when(cond, v)
    aggs = [
        F.count(w(F.lit(1))).alias(f"n{sfx}"),
        F.max(w(F.col("late_minutes"))).alias(f"p{sfx}"),
    ]
    if spec.first_seen:
        aggs.append(F.min(w(F.col("captured_at"))).alias(f"f{sfx}"))
    for name, col in spec.extra_max:
        aggs.append(F.max(w(col)).alias(f"{name}{sfx}"))
    return aggs


def _combine(cols: list[Column], how: str) -> Column:
    if len(cols) == 1:
        return cols[0]
    return F.greatest(*cols) if how == "max" else F.least(*cols)


def filtered_snapshots(data: RailData, spec: PeakSpec) -> DataFrame:
    s = data.snapshots(spec.window)
    if spec.cap is not None:
        s = s.where(F.col("late_minutes") <= spec.cap)
    if spec.min_late is not None:
        s = s.where(F.col("late_minutes") >= spec.min_late)
    pred = spec.filt.station_predicate()
    if pred is not None:
        s = s.where(pred)
    return s


def trip_peaks(data: RailData, spec: PeakSpec) -> DataFrame:
    """One row per (trip_id, *dims) with the measures described above."""
    s = filtered_snapshots(data, spec)
    dim_names = [name for name, _ in spec.dims]
    if spec.dims:
        s = s.withColumns({name: col for name, col in spec.dims})
    keys = ["trip_id", *dim_names]
    stored_scope = "resolved_scope" in s.columns

    if spec.filt.is_scoped and stored_scope:
        # Scope resolved at ingest: a plain filter, no bucket arithmetic.
        s = s.where(F.col("resolved_scope").isin(list(spec.filt.scope_set)))
    if spec.filt.is_scoped and not stored_scope:
        buckets = spec.filt.buckets()
        s = s.where(F.col("service_scope").isNull() | F.col("service_scope").isin(list(spec.filt.scope_set)))
        aggs = []
        for bk in buckets:
            aggs += _base_aggs(spec, bucket_condition(bk), f"_{bk}")
        pre = s.groupBy(*keys).agg(*aggs)
        trips = data.trips().select("trip_id", heuston_trip().alias("_heuston_trip"),
                                    *spec.trip_cols, *[c.alias(n) for n, c in spec.trip_exprs])
        j = pre.join(trips, "trip_id", "inner")
        sel = {bk: spec.filt.bucket_selected(bk, F.col("_heuston_trip")) for bk in buckets}

        def pick(prefix):
            return [F.when(sel[bk], F.col(f"{prefix}_{bk}")) for bk in buckets]

        out = [F.col(k) for k in keys] + [F.col(c) for c in spec.trip_cols] + \
              [F.col(n) for n, _ in spec.trip_exprs] + [F.col("_heuston_trip")]
        count = None
        for bk in buckets:
            term = F.when(sel[bk], F.col(f"n_{bk}")).otherwise(F.lit(0))
            count = term if count is None else count + term
        out.append(count.cast("long").alias("snapshot_count"))
        out.append(_combine(pick("p"), "max").alias("peak_delay"))
        if spec.first_seen:
            out.append(_combine(pick("f"), "min").alias("first_seen"))
        for name, _ in spec.extra_max:
            out.append(_combine(pick(name), "max").alias(name))
        res = j.select(*out)
        return res.where(F.col("snapshot_count") > 0)

    aggs = [a for a in _base_aggs(spec, None, "")]
    pre = s.groupBy(*keys).agg(*aggs)
    renames = {"n": "snapshot_count", "p": "peak_delay", "f": "first_seen"}
    pre = pre.select(*keys, *[F.col(c).alias(renames.get(c, c)) for c in pre.columns if c not in keys])
    pre = pre.withColumn("snapshot_count", F.col("snapshot_count").cast("long"))
    if spec.trip_cols or spec.trip_exprs or spec.need_join:
        trips = data.trips().select("trip_id", *spec.trip_cols,
                                    *[c.alias(n) for n, c in spec.trip_exprs])
        pre = pre.join(trips, "trip_id", "inner")
    return pre
