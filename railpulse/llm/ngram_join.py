"""N-gram Jaccard join by MinHash banding.

A text's n-grams are its runs of five lower-cased words; a text of one to four words is one n-gram of
them all.  Texts with one and the same set form a class.  Classes whose signatures agree on all rows of
a band are candidates; the bands are chosen so that a pair at the threshold is missed less often than
``MAX_MISS``.  Connected candidates form a cluster, and within it every pair is verified on the full
sets: clusters are cut into blocks by a hash, each pair of blocks is one unit of work, so a large group
is spread over tasks and no pair of it becomes a row -- each unit reports, for each of its classes, the
number of documents linked to it and the smallest class that the links reach.

Results are one row per document: its class (the smallest id of its connected component) and its number
of links (other rows at or above the threshold).  A null text is an empty one; texts without words are
equal to each other and to nothing else.  A null id is replaced by a hash of the text within the join.
Rows that share an id count as one document each.  Ids do not join texts: within the join classes have
numbers of their own, and of several components with one smallest id all but one are named by a hash of
it and of a set digest.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import bounded_batches, cut, mix64, row_key, runs, table, utf8, wrapped
from railpulse.llm.components import components

WIDTH = 5
SIMILARITY = (4, 5)  # as a fraction, so that the comparison is exact
ROWS = 5
MAX_MISS = 1e-4
BLOCK_CLASSES = 256  # classes of one block
BLOCK_NGRAMS = 150_000  # n-grams of one block, about
COLUMNS = 8192  # n-grams that are multiplied at once


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` rows, so that a pair of this similarity shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-similarity ** rows))


BANDS = bands_for(SIMILARITY[0] / SIMILARITY[1], ROWS, MAX_MISS)
_RNG = np.random.default_rng(20240101)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_PLACES = _RNG.integers(0, 1 << 63, max(WIDTH, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ngrams(data: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the n-grams of a UTF-8 text, each once."""
    words = data.decode().lower().encode().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WIDTH, len(h))
    if not width:
        return h
    n = len(h) - width + 1
    x = np.full(n, width, np.uint64)
    for i in range(width):
        x += h[i:n + i] * _PLACES[i]
    return np.unique(mix64(x))


def bands(grams: np.ndarray) -> np.ndarray:
    """Band hashes (int64) of a set; none for the empty one."""
    if not len(grams):
        return np.empty(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(grams), 4096):
        np.minimum(low, (np.multiply.outer(_FACTORS, grams[a:a + 4096]) ^ _SALTS[:, None]).min(1), out=low)
    x = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        x = mix64(x + low.reshape(BANDS, ROWS)[:, i] * _PLACES[i])
    return x.view(np.int64)


def key_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of the sets of ``a`` with those of ``b`` (or of ``a``)."""
    both = a if b is None else a + b
    sizes = [len(x) for x in both]
    owner = np.repeat(np.arange(len(both)), sizes)
    _, column, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(a) if b is None else len(b)), np.int64)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [c, c + COLUMNS])
        m = np.zeros((len(both), COLUMNS), np.float32)
        m[owner[x:y], column[x:y] - c] = 1
        out += (m[:len(a)] @ (m if b is None else m[len(a):]).T).astype(np.int64)
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Which pairs reach the threshold."""
    inter = overlaps(a, b)
    size_a = np.array([len(x) for x in a])
    size_b = size_a if b is None else np.array([len(x) for x in b])
    union = size_a[:, None] + size_b[None, :] - inter
    got = (inter * SIMILARITY[1] >= union * SIMILARITY[0]) & (inter > 0)
    if b is None:
        np.fill_diagonal(got, False)
    return got


def smallest_reached(adjacent: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each node the smallest id of its component in a symmetric matrix."""
    label = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], top).min(1))
        if (new == label).all():
            return label
        label = new


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, row, key, n, bands) of each row of ``docs``: row id, hash of id and text, set digest, set size,
    band hashes."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = [ngrams(x) for x in utf8(batch.column(1))]
            sigs = [bands(s) for s in sets]
            ends = np.cumsum([0] + [len(s) for s in sigs]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([key_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                 pa.ListArray.from_arrays(ends, np.concatenate(sigs) if sigs else np.empty(0, np.int64))],
                names=["rid", "row", "key", "n", "bands"])

    rid = F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(F.col(text_col)))
    return docs.select(rid.alias("rid"), F.col(text_col), F.xxhash64(id_col, text_col).alias("row")).mapInArrow(
        run, "rid bigint, row bigint, key binary, n int, bands array<bigint>")


def _verify(units: DataFrame) -> DataFrame:
    """(node, links, root, parted) from rows (cluster, bi, bj, block, node, key, copies, parted, grams) of block pairs."""
    def run(batches):
        for t in runs(batches, ["cluster", "bi", "bj"]):
            seen = dict(zip(t.column("key").to_pylist(), range(t.num_rows), strict=True))
            rows = sorted(seen.values())  # a class once, if its row is repeated
            node = np.asarray(t.column("node"))[rows]
            copies = np.asarray(t.column("copies"))[rows]
            block = np.asarray(t.column("block"))[rows]
            flat = t.column("grams").combine_chunks()
            ends = np.asarray(flat.offsets)
            values = np.asarray(flat.values).view(np.uint64)
            sets = [values[ends[i]:ends[i + 1]] for i in rows]
            bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
            left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
            full = np.zeros((len(rows), len(rows)), bool)
            if bi == bj:
                full = linked(sets, None)
            elif len(left) and len(right):
                got = linked([sets[i] for i in left], [sets[j] for j in right])
                full[np.ix_(left, right)] = got
                full[np.ix_(right, left)] = got.T
            links = full @ copies
            root = smallest_reached(full, node)
            on = links > 0
            if on.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[on]), pa.array(links[on].astype(np.int64)), pa.array(root[on]),
                     pa.array(np.full(int(on.sum()), t.column("parted")[0].as_py()))],
                    names=["node", "links", "root", "parted"])

    dealt = units.repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj", "key")
    return dealt.mapInArrow(run, "node bigint, links bigint, root bigint, parted boolean")


def _placed(sigs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, root, n_links, rid, row) of each class: its component, links of a row of it, and the smallest
    id with a row that has it."""
    least = F.min(F.struct("rid", "row")).alias("least")
    # numbers of classes, settled by the checkpoint
    classes = cut(sigs.groupBy("key").agg(least, F.count("*").alias("copies"), F.min("n").alias("n"), F.first("bands").alias(
        "bands")).withColumn("node", F.monotonically_increasing_id()))
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    near = components(banded.join(buckets, "band").where("node <> low").select(
        F.col("node").alias("u"), F.col("low").alias("v")).distinct())
    members = near.withColumnRenamed("root", "cluster").join(
        classes.select("node", "key", "copies", "n", F.col("least.row").alias("row")), "node")
    sizes = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_NGRAMS)).cast("int").alias("blocks"))
    members = cut(members.join(sizes, "cluster").select(
        "cluster", "node", "key", "copies", "row", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.xxhash64(id_col, text_col).alias("row"), text.alias("text"))

    def read(batches):
        for batch in batches:
            sets = [ngrams(x) for x in utf8(batch.column(batch.schema.get_field_index("text")))]
            keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
            mine = pa.array([key_of(s) == k for s, k in zip(sets, keys, strict=True)], pa.bool_())
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            grams = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))
            names = ["cluster", "node", "key", "copies", "blocks", "block"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), grams],
                                             names=[*names, "grams"]).filter(mine)

    sets = own.join(members, "row").mapInArrow(
        read, "cluster bigint, node bigint, key binary, copies bigint, blocks int, block int, grams array<bigint>")
    units = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "key",
        "copies", (F.col("blocks") > 1).alias("parted"), "grams")
    found = cut(_verify(units))
    # the root of a cluster in one block is final; those of a parted one are joined by their edges
    wide = components(found.where("parted").select(F.col("node").alias("u"), F.col("root").alias("v")))
    whole = found.where("not parted").select("node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    return cut(classes.join(whole.unionByName(wide), "node", "left").join(links, "node", "left").select(
        "key", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        "least.rid", "least.row"))


def _heads(placed: DataFrame) -> DataFrame:
    """(root, head) of each component: the (rid, row, key) of its class with the smallest id."""
    return placed.groupBy("root").agg(F.min(F.struct("rid", "row", "key")).alias("head"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links) of each row of ``docs``."""
    sigs = cut(signatures(docs, id_col, text_col))
    placed = _placed(sigs, docs, id_col, text_col)
    heads = _heads(placed).select("root", "head.rid", "head.key")
    shared = heads.groupBy("rid").agg(F.count("*").alias("_n"), F.min("key").alias("first")).where("_n > 1").drop("_n")
    named = heads.join(shared, "rid", "left").select("root", F.when(
        F.col("key") > F.col("first"), F.xxhash64("rid", "key")).otherwise(F.col("rid")).alias("class_id"))
    classes = placed.select("key", "root", "n_links").join(named, "root").select("key", "class_id", "n_links")
    return sigs.select("rid", "key").join(classes, "key").select(F.col("rid").alias(id_col), "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that with the smallest id (among equal ids the text whose hash
    with it is smallest); all columns as they were, whatever their names.

    Nulls and empty texts share a class with those of equal word sets; of rows that repeat id and text one is
    kept; an empty table gives an empty one.  Long texts are read one batch at a time.
    """
    heads = _heads(_placed(cut(signatures(docs, id_col, text_col)), docs, id_col, text_col))
    rows = wrapped(docs, row=F.xxhash64(id_col, text_col), key=row_key(F.col(id_col), F.col(text_col)))
    kept = rows.join(heads.select("head.row").distinct(), "row", "left_semi")
    # most rows are there once; those that repeat id and text are settled here
    # (by the hash that the rows are dealt by already, so that no text is dealt again)
    again = kept.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row")
    single = kept.join(again, "row", "left_anti")
    several = kept.join(again, "row", "left_semi").dropDuplicates(["key"])
    return single.select("doc.*").unionByName(several.select("doc.*"))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every row of ``documents``."""
    return join(table(spark, sf_dir, "documents"))
