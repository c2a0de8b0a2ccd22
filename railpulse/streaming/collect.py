"""The collector as a Structured Streaming job (O-T1..O-T4).

landed poll documents ──readStream──▶ parse (from_xml) ──▶ route to scopes
  ──▶ change filter (applyInPandasWithState) ──foreachBatch──▶
      1. trip upsert (first write wins)        -> <root>/trips
      2. snapshot append                        -> <root>/snapshots
      3. states and metrics of the touched rows -> <root>/states, <root>/metrics
      4. commit of all of them at once          -> <root>/_commits

Landing format: JSON lines ``{board_station, polled_at, page, payload}`` – the
board documents of a station poll, ``polled_at`` being the poll instant that
becomes ``captured_at`` of every row in them.  A large board comes in several
pages (none given: 0); a train's readings of one poll are in one of them.

Polls outside the service hours are not collected, and road services and the
other scope's trains are dropped in every mode.  Documents that are not
well-formed go to ``<root>/rejects``.

Exactly-once: a batch writes folders named by the stream's own id and the batch
number, and its commit notes that number for the stream.  A batch that the log
has is not written again; one that failed before its commit replaces what it has
left.  Another stream on the same store, with another checkpoint, has another id,
so it replaces nothing; readings that the store has already, because the new
stream reads the same documents, are left out.  Without a checkpoint of the
caller's the stream keeps it in the store, so a restart goes on where it ended.
The ``trip_id`` is a hash of the natural key, so snapshots need no join to find
their trip.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.functions.constants import HEUSTON_CODE
from railpulse.operators import dataops as D
from railpulse.operators import metrics_table as MT
from railpulse.operators.catalog import normalize_code
from railpulse.operators.live import board_filter, route_live_rows, scope_rows
from railpulse.sources import folders
from railpulse.sources.commits import Conflict, Version
from railpulse.sources.payloads import malformed, parse_live
from railpulse.sources.tables import BATCH, SNAPSHOT_SCHEMA, TRIP_SCHEMA, ParquetStore
from railpulse.streaming.state import change_filter, only_batches_with_data

LANDED_SCHEMA = "board_station STRING, polled_at TIMESTAMP_NTZ, page INT, payload STRING"
# Poll instants keep their microseconds in the landed JSON.
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
SNAPSHOT_COLUMNS = ("trip_id", "station_code", "station_full_name", "service_scope", "sch_depart",
                    "sch_arrival", "exp_depart", "exp_arrival", "status", "late_minutes", "captured_at")


def land(payloads: DataFrame, path: str) -> None:
    """Append poll documents to a landing folder (tests / replays)."""
    page = "page" if "page" in payloads.columns else F.lit(0).alias("page")
    (payloads.select("board_station", "polled_at", page, "payload").write.mode("append")
     .option("timestampNTZFormat", TS_FORMAT).json(path))


def read_landed_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LANDED_SCHEMA).option("timestampNTZFormat", TS_FORMAT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.json(path)


def live_rows(landed: DataFrame, catalog: DataFrame | None = None, scope: str | None = None,
              rules: bool = True, columns: Iterable[str] | None = None) -> DataFrame:
    """Parse documents, stamp the poll instant, route to scopes.

    ``rules`` applies the service hours and the scope's filters; without them
    every row is only stamped with ``scope``.  ``columns`` are the fields of a
    row that are parsed, all if none are given.
    """
    if rules:
        landed = landed.where(D.in_service_hours("polled_at"))
    rows = parse_live(landed, columns=columns).withColumn("captured_at", F.col("polled_at")) \
        .withColumn("_seq", F.col("position"))
    if catalog is not None:
        rows = route_live_rows(rows, catalog)
    elif rules:
        rows = scope_rows(rows, scope)
    else:
        rows = rows.withColumn("service_scope", F.lit(scope))
    return rows


# Fields of a live row that a store keeps.
STORED_FIELDS = (*D.TRIP_KEY, *D.TRIP_ATTRS, "station_code", "station_full_name", "sch_depart", "sch_arrival",
                 "exp_depart", "exp_arrival", "status", "late_minutes")
# What tells a reading from another of the same poll.
READING = ("trip_id", "station_code", "service_scope", "sch_depart", "late_minutes", "captured_at")
TRIES = 20


def write_batch(store: ParquetStore, batch: DataFrame, batch_id: int, run: str) -> None:
    """Write and commit one batch of the stream ``run``, unless it is committed already."""
    base = store.latest()
    if base.runs.get(run, -1) >= batch_id:
        return
    # Read by several actions: without this, each would parse and run the state function again.  A batch comes with its
    # stream's session, which plans every step for as many partitions as there are of the state; read from a folder
    # it has the store's session, which sizes them by the rows.
    place = f"{store.root}/_batches/{run}-{batch_id}"
    batch = batch.withColumn("poll_id", F.col("_seq").cast("long"))
    batch.write.mode("overwrite").parquet(place)
    rows = store.spark.read.schema(batch.schema).parquet(place)
    try:
        for attempt in range(TRIES):
            if base.runs.get(run, -1) >= batch_id:
                return
            try:
                return _write_batch(store, base, rows, batch_id, run)
            except Conflict:  # maintenance or another stream has changed what this batch has read
                if attempt == TRIES - 1:
                    raise
                base = store.latest()
    finally:
        folders.delete(store.spark, place)


def _write_batch(store: ParquetStore, base: Version, batch: DataFrame, batch_id: int, run: str) -> None:
    spark, at, name = store.spark, store.at(base), f"{run}-{batch_id}"
    # 1. snapshots, trip_id derived from the natural key.
    snaps = batch.withColumn("trip_id", D.trip_id_expr()).select(
        *[F.col(c) if c in batch.columns or c == "trip_id" else F.lit(None).cast("string").alias(c)
          for c in SNAPSHOT_COLUMNS]).withColumn("service_date", F.to_date("captured_at"))
    dates = [r[0] for r in snaps.select("service_date").distinct().collect()]  # a handful
    others = [f for d in dates for f in base.of("snapshots", MT.day(d)) if f"/{BATCH}={run}-" not in f]
    if others:
        stored = store.read_folders("snapshots", others, SNAPSHOT_SCHEMA).select(*READING)
        snaps = snaps.join(stored, D.null_safe_on(snaps, stored, READING), "left_anti")
    added = {"snapshots": MT.write_dated(store, "snapshots", snaps, name)}
    if not added["snapshots"]:
        return
    snaps = store.read_folders("snapshots", added["snapshots"], SNAPSHOT_SCHEMA)
    # 2. trips first seen in this batch; the lookup is restricted to the batch's keys.
    cand = D.first_write_trips(batch).withColumn("trip_id", D.trip_id_expr()) \
        .join(snaps.select("trip_id").distinct(), "trip_id", "left_semi")
    trips = at.trips()
    # The batch's candidate keys are small; AQE broadcasts them after measuring.
    keys = cand.select("trip_id", "train_date")
    seen = trips.join(keys, D.null_safe_on(trips, keys, ["trip_id", "train_date"]), "left_semi")
    fresh = cand.join(seen, D.null_safe_on(cand, seen, ["trip_id", "train_date"]), "left_anti")
    columns = TRIP_SCHEMA.fieldNames()
    fresh.select(*columns).write.mode("overwrite").parquet(f"{store.trips_path}/{BATCH}={name}")
    fresh = store.read_folders("trips", [f"{BATCH}={name}"], TRIP_SCHEMA)
    if fresh.isEmpty():
        folders.delete(spark, f"{store.trips_path}/{BATCH}={name}")
        fresh = spark.createDataFrame([], TRIP_SCHEMA)
    else:
        added["trips"] = [f"{BATCH}={name}"]
    # 3. states and metrics of what this batch touches.
    more, removed = MT.merge_batch(store, base, name, snaps, seen.select(*columns).unionByName(fresh.select(*columns)), dates)
    store.log.commit(base, added | more, removed, run=(run, batch_id), now=time.time(),
                     same=[("trips", ""), *((t, MT.day(d)) for t in ("states", "metrics") for d in dates)])


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of a checkpoint folder; it stays the same over restarts."""
    return json.loads(folders.read_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


def start_collect(spark: SparkSession, landing: str, store_root: str, checkpoint: str | None = None,
                  catalog: DataFrame | None = None, scope: str | None = None,
                  trigger: dict | None = None, max_files: int | None = None):
    """Start the collector; ``trigger`` defaults to the 30 s poll period, ``checkpoint`` to a folder of the store."""
    checkpoint = checkpoint or f"{store_root.rstrip('/')}/_checkpoints/collect-{scope or 'routed'}"
    store = ParquetStore(spark, store_root)
    # The minutes due are not stored, but what is no number there spoils its row, so they are parsed.
    rows = live_rows(read_landed_stream(spark, landing, max_files), catalog, scope, columns=(*STORED_FIELDS, "due_in"))
    changed = change_filter(rows.select(*STORED_FIELDS, "service_scope", "captured_at", "_seq"))
    writer = changed.writeStream.foreachBatch(
        lambda df, bid: write_batch(store, df, bid, stream_id(spark, checkpoint))) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"processingTime": "30 seconds"}))
    with only_batches_with_data(spark):
        return writer.start()


def start_rejects(spark: SparkSession, landing: str, store_root: str, checkpoint: str,
                  trigger: dict | None = None):
    """Append documents that cannot be parsed to ``<root>/rejects``."""
    return (malformed(read_landed_stream(spark, landing)).writeStream.format("parquet")
            .option("path", f"{store_root.rstrip('/')}/rejects").option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def start_change_stream(spark: SparkSession, landing: str, out_path: str, checkpoint: str,
                        scope: str | None = None, max_files: int | None = None):
    """Only the change filter, appending emitted rows to Parquet."""
    changed = change_filter(live_rows(read_landed_stream(spark, landing, max_files), None, scope, rules=False))
    with only_batches_with_data(spark):
        return (changed.writeStream.format("parquet").option("path", out_path)
                .option("checkpointLocation", checkpoint).outputMode("append")
                .trigger(availableNow=True).start())


def start_live_board(spark: SparkSession, landing: str, board_path: str, checkpoint: str,
                     trigger: dict | None = None):
    """O-T6 streaming form: the current board of every station.

    A streaming aggregation keeps, per station and page, the newest document
    (state: one row each); each trigger rewrites the updated pages' boards
    (parsed, bus and Heuston filters applied) with dynamic partition overwrite.
    ``read_live_board`` leaves out pages of a station's earlier polls.
    """
    landed = read_landed_stream(spark, landing).withColumn("page", F.coalesce("page", F.lit(0)))
    newest = landed.groupBy("board_station", "page").agg(
        F.max_by("payload", "polled_at").alias("payload"), F.max("polled_at").alias("polled_at"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = parse_live(batch).where(board_filter(normalize_code("board_station") == F.lit(HEUSTON_CODE)))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("board_station", "page").parquet(board_path))

    return (newest.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def read_live_board(spark: SparkSession, board_path: str) -> DataFrame:
    """The rows of every station's newest poll that ``start_live_board`` has written."""
    rows = spark.read.parquet(board_path)
    last = rows.groupBy("board_station").agg(F.max("polled_at").alias("polled_at"))
    return rows.join(last, ["board_station", "polled_at"], "left_semi")
