"""Nightly maintenance (O-T5): retention of snapshots and metrics, orphan trips, folding of the collector's small
batch folders.  It may run beside a collector.

All work is on one version of the store and ends in commits; what it replaces is written beside the old, and batches
that are committed meanwhile stay as they are.  Whole service dates before the cutoff go; of the cutoff day the rows
before the cutoff instant go, while its metrics and states stay as computed before (SURVEY Q17).  The folders of
closed days, and those of trips, are folded into one.  Trips that no snapshot names are left out of it, unless a batch
committed meanwhile names one: then the trips are looked at again.  A batch that has looked a trip up and commits after
the fold is refused by the log and looks again.  Running it twice changes nothing more.

Folders that are no longer read are deleted a while later, for the sake of readers that have begun with them.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import functions as F

from railpulse.functions.constants import RETENTION_DAYS
from railpulse.functions.ranges import ntz_literal
from railpulse.operators import dataops as D
from railpulse.operators.metrics_table import folded
from railpulse.sources import folders
from railpulse.sources.commits import Conflict, Version
from railpulse.sources.tables import BATCH, SNAPSHOT_SCHEMA, STATES_SCHEMA, TRIP_SCHEMA, ParquetStore

TRIES = 20
KEEP_RETIRED = dt.timedelta(days=1)


def _by_date(names) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for n in names:
        if n.startswith("service_date="):
            out.setdefault(n.split("/")[0].split("=")[1], []).append(n)
    return out


def _keep_history(store: ParquetStore, base: Version, cutoff: dt.datetime, closed: str) -> dict:
    """Drop what is before the cutoff and fold closed days."""
    date = cutoff.date().isoformat()
    add: dict[str, list[str]] = {"snapshots": [], "states": []}
    remove = {t: [f for d, fs in _by_date(base.of(t)).items() if d < date for f in fs] for t in ("snapshots", "states", "metrics")}
    stats = {"snapshot_days_dropped": len(_by_date(remove["snapshots"])), "metric_days_dropped": len(_by_date(remove["metrics"])),
             "days_compacted": 0}
    before = F.col("captured_at") < ntz_literal(cutoff)

    def put(table: str, names: list[str], rows, parent: str) -> None:
        name = f"{parent}{BATCH}=kept-{uuid.uuid4().hex}"
        rows.drop("service_date").write.parquet(f"{store.path(table)}/{name}")
        remove[table] += names
        if not store.spark.read.parquet(f"{store.path(table)}/{name}").isEmpty():
            add[table].append(name)

    for d, names in _by_date(base.of("snapshots")).items():
        rows = store.read_folders("snapshots", names, SNAPSHOT_SCHEMA)
        cut = d == date and not rows.where(before).isEmpty()
        if cut or date <= d < closed and len(names) > 1:
            put("snapshots", names, rows.where(~before) if cut else rows, f"service_date={d}/")
            stats["days_compacted"] += 1
    for d, names in _by_date(base.of("states")).items():
        if date <= d < closed and len(names) > 1:
            put("states", names, folded(store.read_folders("states", names, STATES_SCHEMA)), f"service_date={d}/")
    undated = [n for n in base.of("snapshots") if not n.startswith("service_date=")]
    if undated:  # a store that was not written by the collector
        rows = store.read_folders("snapshots", undated, SNAPSHOT_SCHEMA)
        if not rows.where(before).isEmpty():
            put("snapshots", undated, rows.where(~before), "")
    if any(remove.values()):
        store.log.commit(base, add, remove, now=time.time())
    return stats


def _keep_trips(store: ParquetStore, base: Version) -> int:
    """Fold trips without those that no snapshot names; the number of the latter."""
    at, names = store.at(base), base.of("trips")
    if not names:
        return 0
    lost = D.orphan_trips(at.trips(), at.snapshots()).select("trip_id")
    n = lost.count()
    if not n and len(names) == 1:
        return 0
    name = f"{BATCH}=kept-{uuid.uuid4().hex}"
    live = D.live_trips(at.trips(), at.snapshots())
    live.select(*TRIP_SCHEMA.fieldNames()).write.parquet(f"{store.trips_path}/{name}")
    kept = store.read_folders("trips", [name], TRIP_SCHEMA)

    def valid(newest: Version) -> bool:
        """No snapshot that came meanwhile names a trip that is left out."""
        new = [f for f in newest.of("snapshots") if f not in base.of("snapshots")]
        gone = at.trips().select("trip_id").join(kept.select("trip_id"), "trip_id", "left_anti")
        return not new or store.read_folders("snapshots", new, SNAPSHOT_SCHEMA).join(gone, "trip_id", "left_semi").isEmpty()

    store.log.commit(base, {"trips": [] if kept.isEmpty() else [name]}, {"trips": names}, valid=valid, now=time.time())
    return n


def _again(store: ParquetStore, work):
    """``work`` on the newest version, again where another writer has changed what it has read."""
    for attempt in range(TRIES):
        try:
            return work(store.latest())
        except Conflict:
            if attempt == TRIES - 1:
                raise


def maintain(store: ParquetStore, as_of: dt.datetime, days: int = RETENTION_DAYS,
             keep_retired: dt.timedelta = KEEP_RETIRED) -> dict:
    cutoff = D.retention_cutoff(as_of, days)
    closed = (as_of.date() - dt.timedelta(days=1)).isoformat()  # the day before yesterday and older
    stats = {"cutoff": cutoff.isoformat()} | _again(store, lambda base: _keep_history(store, base, cutoff, closed))
    stats["trips_dropped"] = _again(store, lambda base: _keep_trips(store, base))
    base = store.latest()
    old = [r for r in base.retired if r[2] <= time.time() - keep_retired.total_seconds()]
    for table, name, _ in old:
        for place in store.places(table, name):
            folders.delete(store.spark, place)
    if old:
        store.log.commit(base, {}, forget=[r[:2] for r in old])
    store.log.prune()
    return stats
