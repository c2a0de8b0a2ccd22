"""Batch data operations: change detection, trip upsert, orphans, retention,
service-hours guard.

All are DataFrame transformations; the write helpers only touch whole
partitions of the Parquet store.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railpulse.functions.constants import (
    DAILY_RESET_HOUR, RETENTION_DAYS, SERVICE_END_BEFORE, SERVICE_START_AFTER,
)
from railpulse.functions.ranges import ntz_literal

# Key of the change detector: scope | train | station | train date | departure.
STATE_KEY = ("service_scope", "train_code", "station_code", "train_date", "sch_depart")
TRIP_KEY = ("train_code", "train_date")
TRIP_ATTRS = ("train_type", "origin", "destination", "direction")


def null_safe_on(left: DataFrame, right: DataFrame, cols) -> Column:
    return functools.reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def service_day(ts="captured_at", reset_hour: int | None = DAILY_RESET_HOUR) -> Column:
    """The state epoch of a reading: the date of (captured_at - reset hour)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if reset_hour is None:
        return F.lit(None).cast("date")
    return F.to_date(c - F.make_dt_interval(F.lit(0), F.lit(reset_hour), F.lit(0), F.lit(0)))


# ---------------------------------------------------------------------------
# O-W3 / O-T2: keep a reading iff its lateness differs from the previous one
# ---------------------------------------------------------------------------

def state_changes(rows: DataFrame, key=STATE_KEY, order=("captured_at", "poll_id"),
                  reset_hour: int | None = DAILY_RESET_HOUR) -> DataFrame:
    """Readings whose lateness differs from the previous reading of the key
    within the same service day (the state map is cleared at ``reset_hour``;
    with None the key has one epoch).

    The previous *emitted* value always equals the previous reading's value,
    so this is a ``lag`` comparison.  To keep every window partition bounded
    even when one key carries a large share of all readings, time is cut into
    clock hours: one window pass over (key, day, hour) gives each reading its
    predecessor in the hour.  The first reading of an hour compares against
    the last of the key's preceding hour, found by a second window over the
    first and last readings of the hours only.  Both branches read the same
    shuffled rows, which Spark exchanges once.
    """
    key = [k for k in key if k in rows.columns]
    day = service_day("captured_at", reset_hour).alias("_day")
    part = [*key, "_day"]
    by = [F.col(o) for o in order]
    hour = Window.partitionBy(*part, "_chunk").orderBy(*by)
    r = rows.select("*", day, F.date_trunc("hour", "captured_at").alias("_chunk")).select(
        "*", F.lag("late_minutes").over(hour).alias("_prev"),
        (F.row_number().over(hour) == 1).alias("_first"), F.lead(F.lit(1)).over(hour).isNull().alias("_last"))
    inner = r.where(~F.col("_first"))
    edges = r.where(F.col("_first") | F.col("_last"))
    epoch = Window.partitionBy(*part).orderBy("_chunk", *by)
    firsts = edges.withColumn("_prev", F.lag("late_minutes").over(epoch)).where(F.col("_first"))
    out = inner.unionByName(firsts).where(~F.col("_prev").eqNullSafe(F.col("late_minutes")))
    return out.drop("_day", "_chunk", "_prev", "_first", "_last")


# ---------------------------------------------------------------------------
# O-S6: trip get-or-create, first write wins
# ---------------------------------------------------------------------------

def trip_id_expr(key=TRIP_KEY) -> Column:
    """Stable 64-bit surrogate from the natural key (NULL parts marked)."""
    return F.xxhash64(*[F.coalesce(F.col(k), F.lit("\u0000")) for k in key], *[F.col(k).isNull() for k in key])


def first_write_trips(rows: DataFrame, key=TRIP_KEY, order=("captured_at", "poll_id")) -> DataFrame:
    """One trip per natural key with the attributes of its earliest reading.

    A ``min`` over a struct led by the ordering columns: mergeable, so a key
    holding many readings is reduced map-side before the shuffle.
    """
    attrs = [a for a in TRIP_ATTRS if a in rows.columns]
    first = rows.groupBy(*key).agg(
        F.min(F.struct(*[F.col(o) for o in order], *[F.col(a) for a in attrs])).alias("_first"))
    return first.select(*key, *[F.col(f"_first.{a}").alias(a) for a in attrs])


def upsert_trips(existing: DataFrame, rows: DataFrame, key=TRIP_KEY) -> DataFrame:
    """Existing trips plus trips first seen in ``rows`` (NULL key parts match
    NULL).  Existing attributes are never overwritten."""
    cand = first_write_trips(rows, key)
    fresh = cand.join(existing, null_safe_on(cand, existing, key), "left_anti")
    cols = [c for c in existing.columns]
    if "trip_id" in cols and "trip_id" not in fresh.columns:
        fresh = fresh.withColumn("trip_id", trip_id_expr(key))
    return existing.unionByName(fresh.select(*cols))


# ---------------------------------------------------------------------------
# O-S12: orphan trips; O-S10/S9: retention
# ---------------------------------------------------------------------------

def orphan_trips(trips: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Trips with no snapshot (NOT IN over a non-null key == anti join)."""
    return trips.join(snapshots.select("trip_id").distinct(), "trip_id", "left_anti")


def live_trips(trips: DataFrame, snapshots: DataFrame) -> DataFrame:
    return trips.join(snapshots.select("trip_id").distinct(), "trip_id", "left_semi")


def retention_cutoff(as_of: dt.datetime, days: int = RETENTION_DAYS) -> dt.datetime:
    return as_of - dt.timedelta(days=days)


def snapshots_retained(snapshots: DataFrame, as_of: dt.datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows kept by the snapshot retention: captured at or after now - days."""
    return snapshots.where(F.col("captured_at") >= ntz_literal(retention_cutoff(as_of, days)))


# ---------------------------------------------------------------------------
# O-P12: collector operating hours
# ---------------------------------------------------------------------------

def in_service_hours(ts="captured_at") -> Column:
    """Active when the wall-clock time is after 05:59:59 or before 00:31."""
    c = F.col(ts) if isinstance(ts, str) else ts
    # Seconds of the day from zone-free field extraction (plus the fraction).
    tod = (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("double") \
        + F.date_format(c, "SSSSSS").cast("double") / 1e6

    def secs(hms: str) -> int:
        h, m, s = (int(x) for x in hms.split(":"))
        return h * 3600 + m * 60 + s
    return (tod > F.lit(float(secs(SERVICE_START_AFTER)))) | (tod < F.lit(float(secs(SERVICE_END_BEFORE))))
