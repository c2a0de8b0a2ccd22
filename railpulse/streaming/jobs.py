"""Streaming runs over data derived from the test tables (used by the query
catalogue, tests and bench).

Poll documents are rendered from binding B (pages of each station poll)
and landed in time order in several slices, so the stream sees several
micro-batches and the change state carries across them.  The collector's runs
store what they collect; the queries return what is stored.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.functions.constants import CONNOLLY
from railpulse.session import checkpoint_root
from railpulse.sources import folders
from railpulse.sources.bindings import polls
from railpulse.sources.payloads import LIVE_FIELDS
from railpulse.sources.payloads import poll_documents as pages_of_polls
from railpulse.sources.tables import ParquetStore
from railpulse.streaming.collect import SNAPSHOT_COLUMNS, land, start_change_stream, start_collect
from railpulse.streaming.maintenance import maintain

SLICES = 4


def poll_documents(spark: SparkSession, sf_dir: str, more: dict[str, Column] | None = None) -> DataFrame:
    """(board_station, polled_at, page, payload) from binding B; ``more`` are further fields of a live row."""
    p = polls(spark, sf_dir).withColumns(more or {})
    missing = [name for _, name, _ in LIVE_FIELDS if name not in p.columns]
    rows = p.withColumns({name: F.lit(None).cast("string") for name in missing}).withColumns(
        {"board_station": F.col("station_code"), "polled_at": F.col("captured_at")})
    return pages_of_polls(rows, ["board_station", "polled_at"], ["poll_id"], ["train_code", "train_date", "sch_depart"])


def landed_slices(spark: SparkSession, sf_dir: str, root: str, docs: DataFrame) -> Iterator[int]:
    """Render documents once and land them in equal spans of the polls' own time, yielding after each."""
    micros = F.unix_micros(F.col("polled_at").cast("timestamp"))
    lo, hi = polls(spark, sf_dir).agg(F.min(F.unix_micros(F.col("captured_at").cast("timestamp"))),
                                      F.max(F.unix_micros(F.col("captured_at").cast("timestamp")))).first()
    lo, hi = lo or 0, hi or 0
    step = (hi - lo) // SLICES + 1
    docs.withColumn("slice", F.floor((micros - F.lit(lo)) / F.lit(step)).cast("int")) \
        .write.partitionBy("slice").parquet(f"{root}/rendered")
    rendered = spark.read.parquet(f"{root}/rendered")
    for i in range(SLICES):
        land(rendered.where(F.col("slice") == i), f"{root}/landing")
        yield i


def stream_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land binding-B poll documents in time slices, run the change stream over
    each (availableNow, one checkpoint), return the emitted rows.

    A stream has to run before there is a result to read, so this starts it;
    the documents are rendered once, and only the emitted rows stay on disk.
    """
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    for _ in landed_slices(spark, sf_dir, root, poll_documents(spark, sf_dir)):
        start_change_stream(spark, f"{root}/landing", f"{root}/out", f"{root}/ckpt", scope=CONNOLLY).awaitTermination()
    for part in ("rendered", "landing", "ckpt"):
        folders.delete(spark, f"{root}/{part}")
    return spark.read.parquet(f"{root}/out").select(
        "train_code", "station_code", "train_date", "late_minutes", "captured_at")


def more_fields() -> dict[str, Column]:
    """Live fields that binding B does not have."""
    return {
        "station_full_name": F.concat(F.lit("Station "), F.col("station_code")),
        "sch_arrival": F.date_format("captured_at", "HH:mm"),
        "exp_arrival": F.date_format("captured_at", "HH:mm:ss"),
        "exp_depart": F.when(F.pmod("poll_id", F.lit(3)) == 0, F.lit("")).otherwise(F.date_format("captured_at", "mm:ss")),
        "status": F.when(F.col("late_minutes") > 0, F.lit("Late")).otherwise(F.lit("En Route")),
    }


# Retention of the maintenance run: a cutoff in the midst of a day.
MAINTAIN_AS_OF = dt.datetime(2024, 1, 25, 12, 0)
MAINTAIN_DAYS = 14


def collected_store(spark: SparkSession, sf_dir: str) -> ParquetStore:
    """A store into which the collector of one scope has taken all polls, slice by slice.

    Each slice is a start of its own; the second half is collected by another stream, which reads all documents
    again, so it also shows that a store outlives its stream.
    """
    root = f"{checkpoint_root(spark)}/collect-{uuid.uuid4().hex}"
    for i in landed_slices(spark, sf_dir, root, poll_documents(spark, sf_dir, more_fields())):
        start_collect(spark, f"{root}/landing", f"{root}/store", f"{root}/ckpt-{2 * i // SLICES}", scope=CONNOLLY,
                      trigger={"availableNow": True}).awaitTermination()
    folders.delete(spark, f"{root}/rendered")
    return ParquetStore(spark, f"{root}/store")


def stored_readings(store: ParquetStore) -> DataFrame:
    """Stored snapshots with the trip that their id names, and trips without a snapshot."""
    trips = store.trips().withColumnRenamed("trip_id", "id_of_trip")
    snaps = store.snapshots()
    return snaps.join(trips, snaps["trip_id"] == trips["id_of_trip"], "full_outer").select(
        "train_code", "train_date", "train_type", "origin", "destination", "direction",
        (F.col("trip_id") == F.col("id_of_trip")).alias("has_trip"), *SNAPSHOT_COLUMNS[1:], "service_date")


def collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a collector run stores."""
    return stored_readings(collected_store(spark, sf_dir))


def collect_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily metrics that the collector has kept up batch by batch."""
    return collected_store(spark, sf_dir).metrics().drop("updated_at")


def maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored after a collector run and a night's maintenance."""
    store = collected_store(spark, sf_dir)
    maintain(store, MAINTAIN_AS_OF, MAINTAIN_DAYS)
    return stored_readings(store)
