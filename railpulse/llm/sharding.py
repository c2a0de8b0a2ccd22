"""Sharding by Karmarkar-Karp differencing: groups of equal texts go whole to one of k shards, so that
the shards' bytes come out near equal.

A partial partition is k sums.  Differencing takes the two partial partitions with the largest spread
(largest minus smallest sum) and adds them oppositely ordered; what remains when one is left is the
result.  On Spark it runs as a tree: groups are dealt into buckets by a hash of the text, every bucket is
differenced in a task, then the buckets' partial partitions are differenced in super-buckets, and the few
results of those on the driver.  The number of buckets follows from the number of groups alone, so the
result is the same on any cluster.

A null text counts as the empty one; equal texts share a shard whatever their ids; repeated rows get
slots of their own; an empty table gives an empty one.  Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse.llm.common import cut, runs, table

SHARDS = 8
BUCKET_GROUPS = 4096  # groups of texts differenced in one run
SUPER_BUCKETS = 1024  # buckets differenced in one run
SLOT_ROWS = 20_000  # rows numbered in one window partition


def difference(sums: list[list[int]], shards: int) -> tuple[list[int], list[list[list[tuple[int, int]]]]]:
    """Difference partial partitions (each ``shards`` sums) into one.

    Returns the final sums, largest first, and for each of them the (item, part) pairs that make it up.
    """
    heap = []
    for i, s in enumerate(sums):
        order = sorted(range(shards), key=lambda j: (-s[j], j))
        values = [s[j] for j in order]
        heap.append((values[-1] - values[0], i, values, [[(i, j)] for j in order]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        both = []
        for x, y, p, q in zip(a, reversed(b), own, reversed(other), strict=True):
            if len(p) < len(q):
                p, q = q, p
            p.extend(q)
            both.append((x + y, p))
        both.sort(key=lambda z: (-z[0], z[1][0]))
        n += 1
        values = [z[0] for z in both]
        heapq.heappush(heap, (values[-1] - values[0], n, values, [z[1] for z in both]))
    return (heap[0][2], heap[0][3]) if heap else ([], [])


def _level(rows: DataFrame, run: str, item: str, shards: int) -> DataFrame:
    """Difference within each ``run``: rows (run, item, part, sum) become (run, item, part, to)."""
    kind = rows.schema[item].dataType.simpleString()

    def work(batches):
        for t in runs(batches, [run]):
            items = t.column(item).to_pylist()
            part, total = t.column("part").to_pylist(), t.column("sum").to_pylist()
            at: dict = {}
            sums: list[list[int]] = []
            for i, p, s in zip(items, part, total, strict=True):
                if i not in at:
                    at[i] = len(sums)
                    sums.append([0] * shards)
                sums[at[i]][p] += s
            names = list(at)
            _, made = difference(sums, shards)
            to = np.empty((len(sums), shards), np.int32)
            for k, pairs in enumerate(made):
                for i, p in pairs:
                    to[i, p] = k
            yield pa.RecordBatch.from_arrays(
                [pa.array([t.column(run)[0].as_py()] * len(items), pa.int64()), pa.array(items, t.schema.field(item).type),
                 pa.array(part, pa.int32()), pa.array([int(to[at[i], p]) for i, p in zip(items, part, strict=True)], pa.int32())],
                names=[run, item, "part", "to"])

    dealt = rows.select(run, item, "part", "sum").repartition(run).sortWithinPartitions(
        F.col(run), F.col("sum").desc(), F.col(item), F.col("part"))
    return dealt.mapInArrow(work, f"{run} bigint, {item} {kind}, part int, to int")


def assign(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(key, shard) for ``groups`` (key binary, unique; weight bigint), shards near equal in weight."""
    spark = groups.sparkSession
    buckets = max(1, -(-groups.count() // BUCKET_GROUPS))
    supers = -(-buckets // SUPER_BUCKETS)
    leaves = groups.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("long").alias("bucket"), "key",
                           F.lit(0).alias("part"), F.col("weight").alias("sum"))
    first = cut(_level(leaves, "bucket", "key", shards)).withColumnRenamed("to", "slot1")
    sums = first.join(groups, "key").groupBy("bucket", F.col("slot1").alias("part")).agg(F.sum("weight").alias("sum"))
    second = cut(_level(sums.withColumn("super", F.col("bucket") % supers), "super", "bucket", shards)
                 .withColumnRenamed("part", "slot1").withColumnRenamed("to", "slot2"))
    tops = [r.asDict() for r in sums.withColumnRenamed("part", "slot1").join(second, ["bucket", "slot1"])
            .groupBy("super", "slot2").agg(F.sum("sum").alias("sum")).collect()]  # at most shards * supers rows
    parts = [[0] * shards for _ in range(supers)]
    for r in tops:
        parts[r["super"]][r["slot2"]] = int(r["sum"])
    _, made = difference(parts, shards)
    last = spark.createDataFrame([(i, p, k) for k, pairs in enumerate(made) for i, p in pairs],
                                 "super bigint, slot2 int, shard int")
    return first.join(second.join(last, ["super", "slot2"]), ["bucket", "slot1"]).select("key", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each row of ``docs``; slots count from 0 in each shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("weight")))
    placed = rows.join(assign(groups, shards), "key")
    parts = max(1, -(-rows.count() // (SLOT_ROWS * shards)))
    placed = cut(placed.withColumn("sub", F.pmod(F.xxhash64("id", "key"), F.lit(parts))))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "sub").agg(F.count("*").alias("n")).select(
        "shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "sub").orderBy("id", "key")
    return (placed.withColumn("row", F.row_number().over(within) - 1).join(starts, ["shard", "sub"])
            .select(F.col("id").alias(id_col), "size", "text_crc32", "shard",
                    (F.col("start") + F.col("row")).cast("long").alias("slot")))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in 8 shards of near equal bytes, equal texts together."""
    got = shard_documents(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
