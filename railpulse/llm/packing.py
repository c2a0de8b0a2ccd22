"""Best-fit packing of token pieces into sequences of bounded length, bettered by a swap-based local search.

Only lengths matter to a packing, and there are at most ``CAPACITY`` different ones.  Spark counts the pieces of
each length; the plan is made from these counts alone, on bins of equal contents taken together as one kind of
bin with a multiplicity, so its size and cost follow from the capacity and not from the number of rows.

* Start: best fit, longest pieces first; each goes into the fullest bin that takes it.
* Search: while there are more bins than the sum of lengths asks for, pieces go between underfull bins: one
  moves, or is exchanged for one, one for two or two for one, always so that the sum of squared fills grows.
  Bins so run empty and are dropped.

The plan says for every length which ranks go to which sequences and offsets.  Spark numbers the pieces of each
length, in parts of bounded size, and each piece looks its place up.

A null text reads as the empty one and gives one piece, the end token.  Repeated rows, and rows that share an
id, have pieces of their own; which of several pieces of one length goes where follows from the written table
of pieces.  An empty table gives an empty result.  Other columns are not read, whatever their names.  A long
text is tokenised in parts; a task holds the ids of one batch of texts.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse.llm.common import bounded_batches, cut, map_batches, table, utf8
from railpulse.llm.word_bpe import file_content, word_codec

CAPACITY = 4096
END = 1  # id after each document
RANK_ROWS = 50_000  # pieces numbered in one window partition
SEARCH_STEPS = 3_000  # changes that the search tries at most; a plan is whole at any time

Bin = tuple[tuple[int, int], ...]  # (length, number), longest first


def fill_of(content: Bin) -> int:
    return sum(length * n for length, n in content)


def changed(content: Bin, out: tuple[int, ...], into: tuple[int, ...]) -> Bin:
    have = dict(content)
    for x in out:
        have[x] -= 1
    for x in into:
        have[x] = have.get(x, 0) + 1
    return tuple(sorted(((x, n) for x, n in have.items() if n), reverse=True))


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> dict[Bin, int]:
    """Bins (content -> multiplicity) of ``counts`` (length -> number), by best fit with the longest first."""
    rooms: dict[int, dict[Bin, int]] = {}  # free room -> bins
    mask = 0  # a bit for each room that some bin has

    def put(content: Bin, room: int, times: int) -> None:
        nonlocal mask
        if times:
            bins = rooms.setdefault(room, {})
            bins[content] = bins.get(content, 0) + times
            mask |= 1 << room

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = mask >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                content, times = rooms[room].popitem()
                if not rooms[room]:
                    mask &= ~(1 << room)
            else:
                room, content, times = capacity, (), left
            each = room // length  # a bin that takes one is the fullest that takes the next
            full = min(times, left // each)
            put((*content, (length, each)), room - each * length, full)
            rest = left - full * each if full < times else 0
            if 0 < rest < each:
                put((*content, (length, rest)), room - rest * length, 1)
                full += 1
            else:
                rest = 0
            left -= min(full, left // each) * each + rest
            if content:
                put(content, room, times - full)
    return {content: n for bins in rooms.values() for content, n in bins.items()}


@dataclass
class Change:
    """What bin a gives and gets back from bin b."""

    a: Bin
    b: Bin
    give: tuple[int, ...]
    back: tuple[int, ...]


@functools.lru_cache(maxsize=100_000)
def offers(content: Bin) -> tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]:
    """Sum, number and lengths of no piece, each piece and each two pieces of a bin."""
    lengths = [x for x, _ in content]
    some = [(), *((x,) for x in lengths), *itertools.combinations(lengths, 2), *((x, x) for x, n in content if n > 1)]
    return np.array([sum(x) for x in some]), np.array([len(x) for x in some]), some


def best_change(a: Bin, b: Bin, gap: int, least: int) -> Change | None:
    """The move or exchange from ``a`` to ``b`` that adds most to the fill of ``b``: at most ``gap``, which is
    the room there, and over ``least``, beyond which the squared fills grow."""
    (sum_a, n_a, some_a), (sum_b, n_b, some_b) = offers(a), offers(b)
    gain = sum_a[:, None] - sum_b
    # one moves, one for one, two for one, one for two
    allowed = (n_a[:, None] > 0) & (n_a[:, None] + n_b <= 3) & ((n_b > 0) | (n_a[:, None] == 1))
    gain = np.where(allowed & (gain <= gap) & (gain > least), gain, 0)
    i, k = divmod(int(gain.argmax()), len(sum_b))
    return Change(a, b, some_a[i], some_b[k]) if gain[i, k] else None


def search(bins: dict[Bin, int], capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> dict[Bin, int]:
    """Local search on the underfull of ``bins`` until their number is the least that the lengths allow, no
    change makes the squared fills grow, or ``steps`` are done."""
    bins = dict(bins)
    open_bins = {c: n for c, n in bins.items() if fill_of(c) < capacity}
    least = -(-sum(fill_of(c) * n for c, n in open_bins.items()) // capacity)
    dead: set[tuple[Bin, Bin]] = set()  # pairs without a change

    def add(content: Bin, times: int) -> None:
        if times and content:
            bins[content] = bins.get(content, 0) + times
            if fill_of(content) < capacity:
                open_bins[content] = open_bins.get(content, 0) + times

    def take(content: Bin, times: int) -> None:
        for have in (bins, open_bins):
            have[content] -= times
            if not have[content]:
                del have[content]

    def step() -> bool:
        order = sorted(open_bins, key=lambda c: (fill_of(c), c))
        for a in order:  # the emptiest gives
            for b in reversed(order):  # the fullest takes
                if (a, b) in dead or a == b and open_bins[a] < 2 or fill_of(b) < fill_of(a):
                    continue
                gap = capacity - fill_of(b)
                found = best_change(a, b, gap, max(0, fill_of(a) - fill_of(b)))
                if found is None:
                    dead.add((a, b))
                    continue
                times = open_bins[a] // 2 if a == b else min(open_bins[a], open_bins[b])
                take(a, times)
                take(b, times)
                add(changed(a, found.give, found.back), times)
                add(changed(b, found.back, found.give), times)
                return True
        return False

    full = sum(n for c, n in bins.items() if c not in open_bins)
    for _ in range(steps):
        if sum(bins.values()) - full <= least or not step():
            break
        full = sum(n for c, n in bins.items() if c not in open_bins)
        least = -(-sum(fill_of(c) * n for c, n in open_bins.items()) // capacity)
    return bins


def places(bins: dict[Bin, int]) -> np.ndarray:
    """(length, first rank, pieces of it in a bin, first sequence, offset) for each length of each kind of bin,
    by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for content, times in sorted(bins.items(), reverse=True):
        offset = 0
        for length, n in content:
            rows.append((length, rank.get(length, 0), n, sequence, offset))
            rank[length] = rank.get(length, 0) + times * n
            offset += length * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with (sequence_id, offset); lengths are from 1 to ``capacity``."""
    spark = pieces.sparkSession
    names = pieces.columns
    # the written table has fixed parts, so a row's number is the same whenever a task runs again
    rows = cut(pieces.select(F.struct(*names).alias("piece"), F.col(length_col).cast("int").alias("length")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError(f"lengths from {min(counts)} to {max(counts)} do not fit {capacity}")
    plan = places(search(best_fit(counts, capacity), capacity))
    shared = spark.sparkContext.broadcast(plan)  # some rows for each length, however many pieces there are

    parts = max(1, -(-sum(counts.values()) // RANK_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "part").agg(F.count("*").alias("n")).select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("length", "part").orderBy("row")
    ranked = rows.withColumn("within", F.row_number().over(within) - 1).join(starts, ["length", "part"]).select(
        "piece", "length", (F.col("start") + F.col("within")).cast("long").alias("rank"))

    def look_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = shared.value
        length, rank = (np.asarray(batch.column(i)).astype(np.int64) for i in (1, 2))
        # one number orders (length, rank): ranks are below 2 ** 50
        i = np.searchsorted((at[:, 0] << 50) + at[:, 1], (length << 50) + rank, "right") - 1
        _, first, n, sequence, offset = at[i].T
        k = rank - first
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence + k // n), pa.array(offset + k % n * length)],
                                          names=["piece", "sequence_id", "offset"])

    kind = ranked.schema["piece"].dataType.simpleString()
    placed = map_batches(ranked, look_up, f"piece {kind}, sequence_id bigint, offset bigint")
    return placed.select(*[F.col("piece")[n].alias(n) for n in names], "sequence_id", "offset")


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                  capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids) of each row of ``docs``; ``ids=False`` leaves the ids out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(file_content(path))  # a file of fixed size, some MB
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = word_codec(shared.value)
        at, piece, parts = [], [], []
        for k, data in enumerate(utf8(batch.column(1))):
            got = codec.encode(data.decode()) + end
            own = [got[a:a + 4 * capacity] for a in range(0, len(got), 4 * capacity)]
            at += [k] * len(own)
            piece += range(len(own))
            parts += own
        index = np.array(piece, np.int64)
        cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(index * capacity),
                pa.array([len(x) // 4 for x in parts], pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
        names = [id_col, "piece", "start", "length", "ids_crc32"]
        if ids:
            ends = np.cumsum([0] + [len(x) // 4 for x in parts]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(parts), "<i4")))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    return map_batches(docs.select(id_col, text_col), rows,
                       f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids)


def op12_packing(spark, sf_dir: str) -> DataFrame:
    """All pieces of ``documents`` with their places in sequences of at most 4096 tokens."""
    return pack(cut_documents(table(spark, sf_dir, "documents"), ids=False))
