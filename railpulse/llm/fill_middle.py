"""Fill-in-the-middle transformation: a text is cut at two token ends, and its parts are put in another order.

Tokens are runs of other characters with the white space before them; white space at the end of a text is a
token of its own.  The token ends of a text form a set of integers that is kept as a Roaring bitmap is: each
64 Ki of offsets have a container, an array of the low halves, a bitmap or runs, whichever is smallest, and
the containers' cumulative cardinalities are kept beside them.  The k-th token end is found by a search over
the cumulative cardinalities and a select within one container.

Cuts and form follow from a hash of the row's id alone, so a row gives the same result wherever it is.  A text
that is empty or holds a sentinel stays plain.

A null text reads as the empty one (no tokens, plain); a null id hashes as the empty text; rows with one id
are cut by the same draws; repeated rows give repeated results; an empty table gives an empty one.  Other
columns are not read, whatever their names.  A task holds one batch of texts; the set of a very long text is
built one container at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import bounded_batches, map_batches, table, utf8

SEED = 42
TRANSFORMED, SPM = 50, 80  # percent of the texts that are transformed, and of these in the order suffix, prefix, middle
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHUNK = 1 << 16  # offsets of a container
ARRAY_MOST = 4096  # entries of an array container: more take less room as a bitmap
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class ArrayContainer:
    """Low halves in order."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """A bit for each offset, with the number of bits before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CHUNK, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        value = int(self.words[word])
        for _ in range(k - int(self.before[word])):
            value &= value - 1  # drop the lowest bit
        return 64 * word + (value & -value).bit_length() - 1


class RunContainer:
    """Runs of consecutive offsets, with the number of offsets before each."""

    def __init__(self, low: np.ndarray):
        first = np.concatenate([[True], low[1:] != low[:-1] + 1])
        self.start = low[first].astype(np.uint16)
        self.before = np.flatnonzero(first)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.start[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of increasing offsets below ``CHUNK``."""
    run_bytes = 4 * (1 + int(np.count_nonzero(low[1:] != low[:-1] + 1)))
    if run_bytes < min(2 * len(low), CHUNK // 8):
        return RunContainer(low)
    return ArrayContainer(low) if len(low) <= ARRAY_MOST else BitmapContainer(low)


class BoundarySet:
    """Increasing integers in containers; ``add`` takes those of one chunk, chunks in order."""

    def __init__(self):
        self.high: list[int] = []
        self.parts: list = []
        self.total: list[int] = []  # cardinality up to and with each container

    def __len__(self) -> int:
        return self.total[-1] if self.total else 0

    def add(self, high: int, low: np.ndarray) -> None:
        if len(low):
            self.high.append(high)
            self.parts.append(container(low))
            self.total.append(len(self) + len(low))

    def select(self, k: int) -> int:
        """The k-th smallest member, from 0."""
        i = int(np.searchsorted(self.total, k, "right"))
        return self.high[i] * CHUNK + self.parts[i].select(k - (self.total[i - 1] if i else 0))


def token_ends(data: bytes) -> BoundarySet:
    """Offsets in UTF-8 ``data`` at which a token ends."""
    out = BoundarySet()
    codes = np.frombuffer(data, np.uint8)
    for high in range(len(data) // CHUNK + 1):
        # an end at p needs the bytes p - 1 and p; nothing ends at 0
        begin = max(high * CHUNK, 1)
        space = _SPACE[codes[begin - 1:(high + 1) * CHUNK]]
        last = (high + 1) * CHUNK > len(data)  # the text's own end is in this chunk
        low = np.flatnonzero(~space[:-1] & space[1:]) + begin - high * CHUNK
        if last and len(space):
            low = np.append(low, len(data) - high * CHUNK)
        out.add(high, low)
    return out


def transform(doc_id: object, data: bytes, seed: int = SEED, transformed: int = TRANSFORMED,
              spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """(number of tokens, form, code points of prefix and of middle, output) of UTF-8 ``data``."""
    ends = token_ends(data)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not data or h3 % 100 >= transformed or PREFIX in data or SUFFIX in data or MIDDLE in data:
        return n, "plain", None, None, data
    a, b = (ends.select(k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm:
        form, out = "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    else:
        form, out = "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return n, form, len(prefix.decode()), len(middle.decode()), out


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   transformed: int = TRANSFORMED, spm: int = SPM) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [transform(i, data, seed, transformed, spm) for i, data in
               zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True)]
        cols = list(zip(*got, strict=True)) or [()] * 5
        output = pa.array(cols[4], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()),
             pa.array(cols[3], pa.int64()), output], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_batches(docs.select(id_col, text_col), rows,
                       f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: str = "output", form: str = "form"):
    """The text that a row of ``fill_in_middle`` came from, as an expression on its output and form."""
    part = F.split(F.col(output), "<P>|<S>|<M>", -1)  # nothing stands before the first sentinel
    return (F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
            .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col(output)))


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    """Cuts, form and digests of every text of ``documents``."""
    got = fill_in_middle(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents),
draw AS (
  SELECT doc_id, t, tokens, len(tokens) AS n, ('0x' || h[1:8])::BIGINT % (len(tokens) + 1) AS a,
         ('0x' || h[9:16])::BIGINT % (len(tokens) + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c,
         ('0x' || h[25:32])::BIGINT % 100 AS d FROM cut),
parts AS (
  SELECT doc_id, t, n, array_to_string(tokens[1:least(a, b)], '') AS p, array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(tokens[greatest(a, b) + 1:], '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain'
              WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form FROM draw)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
              ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256
FROM parts
"""
