import base64
import bisect
import random
import re
from collections import Counter

import zstandard

from railpulse.llm import quality_rules as q

from .conftest import DIRS


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_query_equals_brute_force(spark, documents):
    got = {r.doc_id: r for r in q.op5_quality_rules(spark, DIRS["small"]).collect()}
    assert len(got) == len(documents)
    z = zstandard.ZstdCompressor(level=q.LEVEL)
    for i, t in documents:
        r, m = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert r.kept == (not r.base_failed and q.in_bands(t.encode(), z)[0])


def test_plain_prose_is_kept_and_junk_is_not(spark):
    labels = spark.read.parquet(f"{DIRS['small']}/labels.parquet")
    got = q.op5_quality_rules(spark, DIRS["small"]).join(labels, "doc_id").where("not base_failed").collect()
    clean, junk = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert all(r.kept for r in clean)
    assert sum(not r.kept for r in junk) > len(junk) / 2


def test_repeat_words_of_many_distinct_words():
    rng = random.Random(4)
    words = [str(rng.randrange(10 ** 9)).encode() for _ in range(9000)]
    words += words[100:110]
    assert q.repeat_words(words) == 20
    assert q.repeat_words([b"a"] * 4) == 0 and q.repeat_words([b"a"] * 6) == 6


def test_edges(docs):
    rows = [(1, None), (2, ""), (3, "a" * 200_000), (None, " \n\t"), (4, "x y\nx y\nx y"), (4, "x y\nx y\nx y")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_dup_lines, r.kept) for r in q.quality(docs(rows)).collect())
    assert got == [(0, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False), (3, 1, 0, False), (4, 6, 2, False), (4, 6, 2, False)]
    assert q.quality(docs([])).count() == 0
    z = zstandard.ZstdCompressor(level=q.LEVEL)
    assert not q.in_bands(random.Random(1).randbytes(50_000), z)[0] and not q.in_bands(b"ab " * 20_000, z)[0]


def test_only_the_chunk_rule_rejects(spark, docs, documents):
    """Clean prose with one run of base64 that leaves the whole ratio within its limits."""
    labels = {r.doc_id for r in spark.read.parquet(f"{DIRS['small']}/labels.parquet").where("quality = 1").collect()}
    prose = "\n".join(t for i, t in documents if i in labels and t.isascii()).encode()
    z = zstandard.ZstdCompressor(level=q.LEVEL)

    def whole(data):
        low, high = q.BAND_LIMITS[bisect.bisect_left(q.BAND_ENDS, len(data))]
        return low <= len(z.compress(data)) / len(data) <= high

    rng, rows = random.Random(7), []
    for size, share in ((40_000, 0.25), (60_000, 0.2), (100_000, 0.3), (150_000, 0.2)):
        assert q.in_bands(prose[:size], z)[0]
        run = base64.b64encode(rng.randbytes(int(size * share * 0.75)))
        for at in (0, int(size * (1 - share)) // 2, int(size * (1 - share))):
            data = prose[:at] + run + prose[at:size - len(run)]
            assert whole(data) and not q.in_bands(data, z)[0]
            rows.append((len(rows), data.decode()))
    tail = prose[:5 * q.CHUNK] + base64.b64encode(rng.randbytes(2250))  # 3,000 bytes, less than a chunk
    assert whole(tail) and q.in_bands(tail[:5 * q.CHUNK], z)[0] and not q.in_bands(tail, z)[0]
    rows.append((len(rows), tail.decode()))
    assert not any(r.kept or r.base_failed for r in q.quality(docs(rows)).collect())
    for rest in (1, 7, 100, 149, 150, 2000):  # a rest of clean prose is no reason, however short
        assert q.in_bands(prose[:5 * q.CHUNK + rest], z)[0]
