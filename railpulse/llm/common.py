"""Helpers that the text operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.session import ensure_checkpoint_dir

#: Rows of an Arrow batch, where the session has no setting of its own: documents can be long, and a
#: worker holds one batch at a time.
BATCH_ROWS = 500


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, wherever it was started.
    A cluster without that folder gets the package as ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, unless the session names a size itself."""
    workers_import(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.conf().contains(key):
        spark.conf.set(key, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: Column, parts: int = 5) -> Column:
    """``crc32(doc_id as text) mod parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def wrapped(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``docs`` in one, ``doc``, beside columns of the caller's: no name of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *(c.alias(n) for n, c in more.items()))


def row_key(doc_id: Column, text: Column) -> Column:
    """SHA-256 that tells rows apart by id and text, nulls included."""
    part = lambda c: F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0"))
    return F.unhex(F.sha2(F.concat(part(doc_id), F.lit("\0"), part(text)), 256))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text of an Arrow column; null reads as the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``df.mapInArrow`` of a function of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows(batch)
            if out is not None and out.num_rows:
                yield out
    return df.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal ``keys`` (integers), from batches that are sorted by them.

    Only the current run is held; whoever builds the key must bound a run's size.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


#: odd multipliers of the mixing step below (constants of the splitmix64 generator)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))
