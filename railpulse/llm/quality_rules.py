"""Quality rules by compression bands: a text's zstandard ratio, whole and of each fixed chunk, must lie
between limits that depend on its length; repetitive texts fall below, incompressible ones above.  One
chunk outside its limits is enough to fail a text.

A null text reads as empty.  Rows are independent: repeated rows and ids give repeated results, an
empty table gives an empty one, and other columns are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from railpulse.llm.common import bounded_batches, map_batches, table, utf8

LEVEL = 3
CHUNK = 4096
#: Bytes up to which a band reaches, and the lowest and highest ratio of a whole text in it.
#: One band more, without an end, follows the last.
#: Plain prose of the labelled documents lies within them with a margin of about 2 per cent.
BAND_ENDS = (150, 300, 600, 1200, 2500, 5000, 10000, 20000, 100000)
BAND_LIMITS = ((0.60, 1.40), (0.58, 1.10), (0.53, 0.90), (0.475, 0.80), (0.45, 0.70), (0.428, 0.65), (0.413, 0.60),
               (0.40, 0.57), (0.382, 0.55), (0.36, 0.55))
#: The same for each full chunk; what follows the last one has the limits of its length.
CHUNK_LIMITS = (0.42, 0.70)
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` words that the text has twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key, base = ids[:n], len(seen)
    size = base
    for i in range(1, width):
        if size > 2 ** 62 // base:  # rank the prefixes, else the next product does not fit
            key = np.unique(key, return_inverse=True)[1]
            size = n
        key, size = key * base + ids[i:n + i], size * base
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i:n + i] |= twice
    return int(covered.sum())


def measures(data: bytes, points: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 ``data`` of ``points`` code points."""
    words = data.split()  # of bytes: at space and \\x09-\\x0D, nothing else
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), points - (len(data) - sum(map(len, words))), len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words))


def limits(length: int) -> tuple[float, float]:
    return BAND_LIMITS[bisect.bisect_left(BAND_ENDS, length)]


def in_bands(data: bytes, z: zstandard.ZstdCompressor) -> tuple[bool, float, float]:
    """Whether ``data`` and each of its chunks are within their limits, its whole ratio, and the share of
    chunks outside theirs.  A text shorter than a chunk is one chunk."""
    if not data:
        return False, 0.0, 0.0
    low, high = limits(len(data))
    ratio = len(z.compress(data)) / len(data)
    ok = low <= ratio <= high
    full = len(data) // CHUNK
    if not full:
        return ok, ratio, float(not ok)
    parts = [(data[i * CHUNK:(i + 1) * CHUNK], CHUNK_LIMITS) for i in range(full)]
    if len(data) % CHUNK:  # a rest of a few bytes is measured with some before it: frames have a fixed part
        rest = data[-max(len(data) % CHUNK, BAND_ENDS[0]):]
        parts.append((rest, limits(len(rest))))
    bad = sum(not lo <= len(z.compress(part)) / len(part) <= hi for part, (lo, hi) in parts)
    return ok and not bad, ratio, bad / len(parts)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measures, base_failed, kept, zstd_ratio, bad_chunk_share) of each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        z, got = zstandard.ZstdCompressor(level=LEVEL), []
        for data in utf8(batch.column(1)):
            m = measures(data, len(data) if data.isascii() else len(data.decode()))
            failed = m[0] < MIN_WORDS or 100 * m[4] > MAX_REPEAT_PERCENT * m[0]
            ok, ratio, share = in_bands(data, z)
            got.append((*m, failed, not failed and ok, ratio, share))
        cols = list(zip(*got, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.bool_()) for c in cols[5:7]]
        arrays += [pa.array(c, pa.float64()) for c in cols[7:]]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[
            id_col, *names, "base_failed", "kept", "zstd_ratio", "bad_chunk_share"])

    return map_batches(docs.select(id_col, text_col), rows, f"`{id_col}` {kind}, " + ", ".join(
        f"{n} bigint" for n in names) + ", base_failed boolean, kept boolean, zstd_ratio double, bad_chunk_share double")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict for every text of ``documents``."""
    return quality(table(spark, sf_dir, "documents"))
