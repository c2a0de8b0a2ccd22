"""Stateful change detection (O-T2/O-T3) for Structured Streaming.

Per key (scope, train, station, train date, scheduled departure, service day)
the lateness last emitted is kept in state.  A reading is emitted iff its
lateness differs from that value; the state then takes the new value.  The
service day (captured_at − 3 h) is part of the key, so the daily reset of the
reference is a new key, and a document that lands late is still compared with
its own day.  Nothing is dropped for being late: there is no watermark, and
state expires by processing time, long after its day has ended.

State is kept for a hash bucket of train keys within a station and day, so a
busy station-day is spread over many groups; the group function works on a
bucket's readings of one micro-batch as a vectorised pandas frame.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from railpulse.functions.constants import DAILY_RESET_HOUR
from railpulse.operators.dataops import service_day

# Ship this module's functions to Python workers by value: workers then need
# nothing from this repository on their path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to import by name
    pass

# State per (scope, station, service day, bucket): the last emitted lateness of
# every train key of the bucket seen there that day, as two parallel arrays.
STATE_SCHEMA = "keys ARRAY<STRING>, lates ARRAY<INT>"
GROUP_COLS = ("service_scope", "station_code", "_service_day", "_bucket")
BUCKETS = 32
# Processing time without a reading after which a bucket's state goes.
EXPIRE_MS = 48 * 3600 * 1000
TRAIN_COLS = ("train_code", "train_date", "sch_depart")
_NULL = "\u0000"


@contextmanager
def only_batches_with_data(spark):
    """Streams started inside run no batch without new data.

    Spark would otherwise run one after the other to let processing time expire
    state, and an ``availableNow`` run would never end; the next poll does it.
    """
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _train_key(rows: pd.DataFrame) -> pd.Series:
    parts = [rows[c].astype(object).where(rows[c].notna(), _NULL).astype(str) for c in TRAIN_COLS]
    out = parts[0]
    for p in parts[1:]:
        out = out + "|" + p
    return out


def _emit_changes(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One bucket of a station-day of one micro-batch, vectorised with pandas."""
    if state.hasTimedOut:
        state.remove()
        return
    frames = [p for p in pdfs if len(p)]
    if not frames:
        return
    rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    rows = rows.assign(_tk=_train_key(rows)).sort_values(["_tk", "captured_at", "_seq"], kind="stable")
    late = rows["late_minutes"].astype("int64")
    prev = late.groupby(rows["_tk"], sort=False).shift(1)
    known = {}
    if state.exists:
        keys, lates = state.get
        known = dict(zip(keys, lates))
    first = prev.isna()
    if known and first.any():
        prev = prev.where(~first, rows["_tk"].map(known))
    changed = prev.isna() | (prev != late)
    lasts = late.groupby(rows["_tk"], sort=False).last()
    known.update({k: int(v) for k, v in lasts.items()})
    state.update((list(known.keys()), [int(v) for v in known.values()]))
    state.setTimeoutDuration(EXPIRE_MS)
    out = rows[changed.to_numpy()].drop(columns=["_tk"])
    if len(out):
        yield out


def change_filter(rows: DataFrame) -> DataFrame:
    """Apply the change filter to a streaming frame of live rows.

    Requires ``service_scope``, ``station_code``, the train key columns,
    ``late_minutes``, ``captured_at`` (wall clock) and a tie-break ``_seq``.
    """
    df = rows.withColumn("_service_day", service_day("captured_at", DAILY_RESET_HOUR)) \
             .withColumn("_bucket", F.pmod(F.xxhash64(*TRAIN_COLS), F.lit(BUCKETS)).cast("int"))
    return df.groupBy(*GROUP_COLS).applyInPandasWithState(
        _emit_changes, outputStructType=df.schema, stateStructType=STATE_SCHEMA,
        outputMode="append", timeoutConf=GroupStateTimeout.ProcessingTimeTimeout,
    ).drop("_service_day", "_bucket")
