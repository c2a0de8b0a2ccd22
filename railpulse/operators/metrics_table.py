"""The stored daily metrics: an incremental view over the snapshots, with the states that it is made from.

A batch adds its own trip states.  Only metrics rows that it touches are made anew, from the states of those rows;
the others of its dates are copied, as a day's metrics are few beside its snapshots.  Every change is one commit of
the store, so a reader has a day's metrics before or after it.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.operators.dataops import null_safe_on
from railpulse.operators.metrics import GRAIN, metrics_from_states, trip_states
from railpulse.sources import folders
from railpulse.sources.commits import Conflict, Version
from railpulse.sources.tables import BATCH, METRICS_SCHEMA, STATES_SCHEMA, FrameData, ParquetStore, RailData

FOLD = 32  # folders of a day's states after which a batch folds them into its own
TRIES = 20  # times a refresh looks again at dates that batches have changed meanwhile

STATE_KEYS = (*GRAIN, "station_full_name", "trip_id")
STATE_COLUMNS = tuple(f.name for f in STATES_SCHEMA.fields)


class OnDates(RailData):
    """The rows of given service dates only (a store reads no others)."""

    def __init__(self, base: ParquetStore, dates: Iterable[dt.date]):
        self.base, self.dates, self.spark = base, sorted(dates), base.spark

    def snapshots(self, window=None) -> DataFrame:
        version, days = self.base.latest() if self.base.version is None else self.base.version, {d.isoformat() for d in self.dates}
        names = [n for n in version.of("snapshots") if not n.startswith("service_date=") or n.split("/")[0].split("=")[1] in days]
        df = self.base.at(Version(version.number, version.tables | {"snapshots": tuple(names)})).snapshots(window)
        on = F.col("service_date") if "service_date" in df.columns else F.to_date("captured_at")
        return df.where(on.cast("date").isin([F.lit(d) for d in self.dates]))

    def trips(self) -> DataFrame:
        return self.base.trips()


def day(date: dt.date) -> str:
    return f"service_date={date.isoformat()}/"


def write_dated(store: ParquetStore, table: str, rows: DataFrame, name: str) -> list[str]:
    """Write rows of a dated table into folders of their own, in place of those that an earlier attempt has left.

    Rows are gathered by date first: else every task would write a file for each date.
    """
    attempt = f"{store.path(table)}/.{name}-{uuid.uuid4().hex}"
    rows.hint("rebalance", "service_date").withColumn(BATCH, F.lit(name)).write.partitionBy("service_date", BATCH).parquet(attempt)
    made = [f"{d}/{BATCH}={name}" for d in folders.children(store.spark, attempt, "service_date=")]
    for n in made:
        folders.move(store.spark, f"{attempt}/{n}", f"{store.path(table)}/{n}")
    folders.delete(store.spark, attempt)
    return made


def folded(states: DataFrame) -> DataFrame:
    """States with one row for each key."""
    return states.groupBy(*STATE_KEYS).agg(F.sum("n").cast("long").alias("n"), F.max("p").alias("p")).select(*STATE_COLUMNS)


def merge_batch(store: ParquetStore, base: Version, name: str, snapshots: DataFrame, trips: DataFrame,
                dates: list[dt.date]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Write the states and metrics that a batch of ``snapshots``, with their ``trips``, makes on top of ``base``.

    Returns the folders to add and to remove, by table.
    """
    spark, at = store.spark, store.at(base)
    earlier = [f for d in dates for f in base.of("states", day(d))]
    delta = trip_states(FrameData(spark, snapshots, trips)).select(*STATE_COLUMNS)
    unknown = [d for d in dates if not base.of("states", day(d)) and any(
        not f.startswith("service_date=") or f.startswith(day(d)) for f in base.of("snapshots"))]
    if unknown:  # snapshots from before the states were kept
        delta = delta.unionByName(trip_states(OnDates(at, unknown)).select(*STATE_COLUMNS))
    added = write_dated(store, "states", delta, name)
    own = store.read_folders("states", added, STATES_SCHEMA)
    states = store.read_folders("states", [*earlier, *added], STATES_SCHEMA)
    remove: dict[str, list[str]] = {}
    many = [d for d in dates if len(base.of("states", day(d))) >= FOLD]
    if many:
        old = [f for d in many for f in base.of("states", day(d))]
        mine = [f for f in added if any(f.startswith(day(d)) for d in many)]
        added = [f for f in added if f not in mine] + write_dated(
            store, "states", folded(store.read_folders("states", [*old, *mine], STATES_SCHEMA)), f"{name}-folded")
        remove["states"] = old
    touched = own.select(*GRAIN).distinct()
    fresh = metrics_from_states(states.join(touched, null_safe_on(states, touched, GRAIN), "left_semi"))
    old_metrics = [f for d in dates for f in base.of("metrics", day(d))]
    if old_metrics:
        kept = store.read_folders("metrics", old_metrics, METRICS_SCHEMA)
        fresh = kept.join(touched, null_safe_on(kept, touched, GRAIN), "left_anti").select(*fresh.columns).unionByName(fresh)
        remove["metrics"] = old_metrics
    return {"states": added, "metrics": write_dated(store, "metrics", fresh, name)}, remove


def dates_of(store: ParquetStore, version: Version) -> set[dt.date]:
    """Service dates that snapshots, states or metrics have."""
    names = [f for t in ("snapshots", "states", "metrics") for f in version.of(t)]
    found = {n.split("/")[0].split("=")[1] for n in names if n.startswith("service_date=")}
    if any(not n.startswith("service_date=") for n in version.of("snapshots")):
        # one row for each day
        rows = store.at(version).snapshots().select(F.to_date("captured_at").cast("string").alias("d")).distinct().collect()
        found |= {r["d"] for r in rows if r["d"]}
    return {dt.date.fromisoformat(d) for d in found if d[:4].isdigit()}


def refresh_dates(store: ParquetStore, dates: Iterable) -> None:
    """O-S8: make states and metrics of service dates anew from their snapshots; a date without any loses its own.

    Dates that a batch changes meanwhile are done again before all are committed at once.
    """
    wanted = {d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)) for d in dates}
    todo, made = set(wanted), {"states": {}, "metrics": {}}
    base = store.latest()
    for attempt in range(TRIES):
        if todo:
            name = f"refreshed-{uuid.uuid4().hex}"
            states = trip_states(OnDates(store.at(base), todo)).select(*STATE_COLUMNS)
            added = write_dated(store, "states", states, name)
            rows = metrics_from_states(store.read_folders("states", added, STATES_SCHEMA))
            for table, names in (("states", added), ("metrics", write_dated(store, "metrics", rows, name))):
                for d in todo:
                    made[table][d] = [n for n in names if n.startswith(day(d))]
        try:
            store.log.commit(
                base, {t: [f for fs in found.values() for f in fs] for t, found in made.items()},
                {t: [f for d in wanted for f in base.of(t, day(d))] for t in made},
                same=[(t, day(d)) for d in wanted for t in ("snapshots", "states", "metrics")], now=time.time())
            return
        except Conflict:
            newest = store.latest()
            todo = {d for d in wanted if newest.of("snapshots", day(d)) != base.of("snapshots", day(d))}
            base = newest
            if attempt == TRIES - 1:
                raise


def rebuild_metrics(store: ParquetStore) -> None:
    """O-S7: make the whole table anew."""
    refresh_dates(store, dates_of(store, store.latest()))
