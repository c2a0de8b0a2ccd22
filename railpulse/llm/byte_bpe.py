"""Byte-level BPE encoding and decoding, in each partition by recursive DuckDB queries.

The rank file gives a merge table: (left token, right token, rank) for every way to cut a token into two
tokens.  Distinct pieces of a partition's texts become rows (piece, position, token).  A recursive query
joins neighbours with the merge table, finds each piece's lowest rank and contracts the leftmost pair that
has it -- with all its further occurrences in the piece, unless the new token can take part in a merge of
lower rank, when the order could matter -- until no piece has a pair left.  Pieces that are tokens
themselves are taken whole, as the tiktoken library does.  Decoding joins token rows with the vocabulary
and aggregates the bytes ordered by position.

A piece of more than ``LONG_BYTES`` is contracted in overlapping windows, all at once, which are joined where two
neighbours have two token ends in common; if some have not, in longer segments one after the other
(:mod:`railpulse.llm.long_pieces` says why both give the ids of the whole piece).  A query's rows and steps are
bounded so, whatever the length of a text or piece.

A null text encodes as the empty one (no ids), empty ids decode to nothing.  Rows are independent:
repeated rows and ids give repeated results, an empty table gives an empty one, other columns are not
read, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterable

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from railpulse.llm.common import bounded_batches, table, utf8
from railpulse.llm.long_pieces import encode_long

RANKS = "byte_bpe_multi_50k.tiktoken"
GROUP_STRETCHES = 200_000  # stretches of the texts that are encoded together (one text at least)
LONG_BYTES = 256  # longer pieces are contracted in windows
WINDOW, STRIDE = 96, 64  # bytes of a window, and from one to the next
LONG_SEGMENT, LONG_OVERLAP = 1 << 14, 256  # bytes where windows do not do
SHORT_BYTES = 32  # pieces up to this size are contracted one pair a step
CALL_BYTES = 200_000  # bytes of the pieces of one recursive query (one piece at least)
CALL_ROWS = 4_000_000  # rows that the steps of one recursive query may hold
CACHE_PIECES = 200_000  # pieces, and stretches, whose ids a worker remembers in each of two generations
DECODE_TOKENS = 500_000  # tokens of one decoding query, and of one ordered aggregate
DECODE_TEXTS = 1000  # texts of one decoding query

ENCODE_SQL = """
WITH RECURSIVE s(w, p, t, done, step) AS (
  SELECT w, p, t, false, 0 FROM chars
  UNION ALL
  (WITH a AS (SELECT w, p, t, step, row_number() OVER k AS i, lead(t) OVER k AS nt, lead(p) OVER k AS np
              FROM s WHERE NOT done AND step < {steps} WINDOW k AS (PARTITION BY w ORDER BY p)),
   m AS (SELECT a.w, a.i, a.p, a.np, g.rank, g.one FROM a JOIN merges g ON a.t = g.l AND a.nt = g.r),
   b AS (SELECT w, min(rank) AS rank, min(rank::BIGINT * 4294967296 + p) % 4294967296 AS first FROM m GROUP BY w),
   h AS (SELECT m.w, m.i, m.p, m.np, m.i - row_number() OVER (PARTITION BY m.w ORDER BY m.i) AS run
         FROM m JOIN b ON m.w = b.w AND m.rank = b.rank WHERE NOT m.one OR m.p = b.first),
   c AS (SELECT w, p, np, row_number() OVER (PARTITION BY w, run ORDER BY i) % 2 = 1 AS pick FROM h)
   SELECT a.w, a.p, CASE WHEN l.w IS NULL THEN a.t ELSE b.rank END, b.w IS NULL, a.step + 1
   FROM a LEFT JOIN b ON a.w = b.w
          LEFT JOIN (SELECT w, p FROM c WHERE pick) l ON a.w = l.w AND a.p = l.p
          LEFT JOIN (SELECT w, np AS p FROM c WHERE pick) r ON a.w = r.w AND a.p = r.p
   WHERE r.w IS NULL)
)
SELECT w, p, t, done FROM s WHERE done OR step = {steps} ORDER BY w, p
"""
#: The same for short pieces, one contraction a step: the pair with the lowest (rank, position).
ENCODE_SHORT_SQL = """
WITH RECURSIVE s(w, p, t, done, step) AS (
  SELECT w, p, t, false, 0 FROM chars
  UNION ALL
  (WITH a AS (SELECT w, p, t, step, lead(t) OVER k AS nt, lead(w) OVER k AS nw, lag(p) OVER k AS before
              FROM s WHERE NOT done AND step < {steps} WINDOW k AS (ORDER BY p)),
   b AS (SELECT a.w, min(g.rank::BIGINT * 4294967296 + a.p) AS best
         FROM a JOIN merges g ON a.t = g.l AND a.nt = g.r WHERE a.w = a.nw GROUP BY a.w)
   SELECT a.w, a.p, CASE WHEN a.p = b.best % 4294967296 THEN (b.best // 4294967296)::INTEGER ELSE a.t END, b.w IS NULL, a.step + 1
   FROM a LEFT JOIN b ON a.w = b.w WHERE b.w IS NULL OR a.before IS NULL OR a.before <> b.best % 4294967296)
)
SELECT w, p, t, done FROM s WHERE done OR step = {steps} ORDER BY w, p
"""
#: Rows reach the aggregate in order of position; one thread and few groups keep them so.
DECODE_SQL = """
SELECT d, string_agg(bytes, '') AS bytes FROM (SELECT d, v.bytes FROM ids JOIN vocabulary v ON ids.t = v.t ORDER BY p) GROUP BY d ORDER BY d
"""


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(l, r, rank, one): one marks tokens that can themselves take part in a merge of lower rank."""
    rows = [(a, b, rank) for token, rank in ranks.items() for i in range(1, len(token))
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
    low: dict[int, int] = {}
    for a, b, rank in rows:
        low[a], low[b] = min(low.get(a, rank), rank), min(low.get(b, rank), rank)
    columns = [pa.array(c, pa.int32()) for c in zip(*rows, strict=True)]
    return pa.table([*columns, pa.array([low.get(x[2], x[2]) < x[2] for x in rows])], names=["l", "r", "rank", "one"])


class Recent(dict):
    """Remembered ids; of two generations, those not asked for in one go with the next."""

    def __init__(self):
        super().__init__()
        self.before: dict[str, bytes] = {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """The distinct keys that are not known; the others are young again."""
        new = [x for x in dict.fromkeys(keys) if x not in self]
        found = {x: self.before[x] for x in new if x in self.before}
        self.update(found)
        return [x for x in new if x not in found]

    def age(self) -> None:
        if len(self) > CACHE_PIECES:
            self.before = {k: v for k, v in self.items() if len(k) <= LONG_BYTES}  # long ones hardly come again
            self.clear()


class Codec:
    """Encoder and decoder over one rank file; one in each Python worker."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("merge_rows", merge_table(self.ranks))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.register("tokens", pa.table({"t": pa.array(self.ranks.values(), pa.int32()),
                                             "bytes": [t.decode("latin-1") for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM tokens")
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            self.sizes[rank] = len(token)
        # pieces never cross from other characters to white space, so these are cut into pieces by themselves
        self.stretch = regex.compile(r"\s*\S+|\s+")
        self.pieces, self.stretches = Recent(), Recent()

    def contract(self, pieces: list[bytes], sql: str) -> list[bytes]:
        """Ids (little-endian 32-bit) of each piece, none of which is a token itself."""
        lengths = np.array([len(x) for x in pieces])
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        p = np.arange(len(w), dtype=np.int32)  # only the order within a piece counts
        t = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[bytes] = [b""] * len(pieces)
        while len(w):
            self.db.register("chars", pa.table({"w": w, "p": p, "t": t}))
            steps = max(1, min(24, CALL_ROWS // len(w)))
            got = self.db.execute(sql.format(steps=steps)).fetchnumpy()
            w, p, t, done = (np.asarray(got[k]) for k in ("w", "p", "t", "done"))
            ready, ids = w[done], t[done].astype("<u4")
            if len(ready):
                cuts = [0, *(np.flatnonzero(ready[1:] != ready[:-1]) + 1).tolist(), len(ready)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    out[ready[a]] = ids[a:b].tobytes()
            w, p, t = w[~done], p[~done], t[~done]
        return out

    def contract_all(self, pieces: list[bytes], sql: str) -> list[bytes]:
        """``contract`` of any number of pieces, some at a time."""
        out: list[bytes] = []
        a = 0
        while a < len(pieces):
            b, size = a, 0
            while b < len(pieces) and (b == a or size + len(pieces[b]) <= CALL_BYTES):
                size += len(pieces[b])
                b += 1
            out += self.contract(pieces[a:b], sql)
            a = b
        return out

    def contract_long(self, piece: bytes) -> bytes:
        """Ids of one long piece."""
        starts = range(0, max(1, len(piece) - WINDOW + STRIDE), STRIDE)
        windows = [np.frombuffer(x, "<u4") for x in self.contract_all([piece[a:a + WINDOW] for a in starts], ENCODE_SHORT_SQL)]
        ends = [a + np.cumsum(self.sizes[x]) for a, x in zip(starts, windows, strict=True)]
        out, settled = [], 0
        for i, ids in enumerate(windows):
            mine = ends[i]
            if i + 1 < len(windows):
                both = np.intersect1d(mine[(mine > max(starts[i + 1], settled)) & (mine < starts[i] + WINDOW)],
                                      ends[i + 1][ends[i + 1] < starts[i + 1] + WINDOW], assume_unique=True)
                if len(both) < 2:
                    break
                until = int(both[0])
            else:
                until = len(piece)
            out.append(ids[(mine > settled) & (mine <= until)])
            settled = until
        if settled == len(piece):
            return np.concatenate(out).astype("<u4").tobytes()

        def part(data: bytes, last: bool) -> tuple[np.ndarray, np.ndarray]:
            ids = np.frombuffer(self.contract([data], ENCODE_SQL)[0], "<u4")
            return ids, self.sizes[ids]

        return encode_long(piece, part, LONG_SEGMENT, LONG_OVERLAP).astype("<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Ids of pieces that are not remembered."""
        some: dict[str, list[tuple[str, bytes]]] = {ENCODE_SHORT_SQL: [], ENCODE_SQL: []}
        for x in pieces:
            data = x.encode()
            if (rank := self.ranks.get(data)) is not None:
                self.pieces[x] = rank.to_bytes(4, "little")
            elif len(data) > LONG_BYTES:
                self.pieces[x] = self.contract_long(data)
            else:
                some[ENCODE_SHORT_SQL if len(data) <= SHORT_BYTES else ENCODE_SQL].append((x, data))
        for sql, todo in some.items():
            self.pieces.update(zip((x for x, _ in todo), self.contract_all([d for _, d in todo], sql), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of each UTF-8 text."""
        out: list[bytes] = []
        group: list[list[str]] = []
        n = 0

        def flush() -> None:
            missing = self.stretches.missing(itertools.chain.from_iterable(group))
            cut = [self.pattern.findall(x) for x in missing]
            self.learn(self.pieces.missing(itertools.chain.from_iterable(cut)))
            self.stretches.update(zip(missing, (b"".join(map(self.pieces.__getitem__, x)) for x in cut), strict=True))
            out.extend(b"".join(map(self.stretches.__getitem__, x)) for x in group)
            group.clear()
            self.pieces.age()
            self.stretches.age()

        for text in texts:
            stretches = self.stretch.findall(text.decode())
            if n + len(stretches) > GROUP_STRETCHES and group:
                flush()
                n = 0
            group.append(stretches)
            n += len(stretches)
        flush()
        return out

    def decode(self, texts: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids (little-endian 32-bit) stands for."""
        parts: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if held:
                d = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for _, x in held])
                self.db.register("ids", pa.table({"d": d, "p": np.arange(len(d), dtype=np.int32),
                                                  "t": np.concatenate([x for _, x in held]).astype(np.int32)}))
                got = self.db.execute(DECODE_SQL).fetchall()
                for k, data in got:
                    parts[held[k][0]].append(data.encode("latin-1"))
                held.clear()

        n = 0
        for i, data in enumerate(texts):
            ids = np.frombuffer(data, "<u4")
            for a in range(0, len(ids), DECODE_TOKENS):
                block = ids[a:a + DECODE_TOKENS]
                if n + len(block) > DECODE_TOKENS or len(held) == DECODE_TEXTS:
                    flush()
                    n = 0
                held.append((i, block))
                n += len(block)
        flush()
        return [b"".join(x) for x in parts]


@functools.cache
def codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def _rank_file(path: str | None) -> bytes:
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return f.read()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None,
           pattern: str = public_tokenizers.PATTERN, digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids array<int>) of each row of ``docs``; with ``digests``, in place of the ids
    SHA-256 of them (as little-endian 32-bit integers) and of the bytes that they decode to."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(_rank_file(rank_path))  # a file of fixed size, about 1 MB
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(shared.value, pattern)
        for batch in batches:
            ids = c.encode(utf8(batch.column(1)))
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            if digests:
                cols = [pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in c.decode(ids)], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, *cols],
                                                 names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                flat = np.frombuffer(b"".join(ids), "<i4")
                ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.ListArray.from_arrays(ends, flat)],
                                                 names=[id_col, "n_tokens", "ids"])

    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, {out}")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_path: str | None = None,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, text) of each row of ``encoded``; bytes that are not UTF-8 become U+FFFD; null ids read as none."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(_rank_file(rank_path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(shared.value, pattern)
        for batch in batches:
            ids = [np.asarray(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
            texts = pa.array([x.decode(errors="replace") for x in c.decode(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded bytes of every text of ``documents``."""
    return encode(table(spark, sf_dir, "documents"), digests=True)
