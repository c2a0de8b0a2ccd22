import itertools
import random
import zlib
from collections import defaultdict

from railpulse.llm import sharding as s

from .conftest import DIRS


def check(rows, got, shards):
    """Sizes, checksums, gapless slots, equal texts together."""
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, home, total = defaultdict(list), defaultdict(set), defaultdict(int)
    text = {(i, zlib.crc32((t or "").encode())): t or "" for i, t in rows}
    for r in got:
        slots[r.shard].append(r.slot)
        home[text[r.doc_id, r.text_crc32]].add(r.shard)
        total[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(shards))
    assert all(len(x) == 1 for x in home.values())
    return [total[k] for k in range(shards)]


def test_query_is_balanced_and_whole(spark, documents):
    got = s.op6_sharding(spark, DIRS["small"]).collect()
    bytes_of = check(documents, got, s.SHARDS)
    assert max(bytes_of) - min(bytes_of) <= 0.001 * sum(bytes_of) / s.SHARDS
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_tree_of_buckets(docs, monkeypatch):
    monkeypatch.setattr(s, "BUCKET_GROUPS", 16)
    monkeypatch.setattr(s, "SUPER_BUCKETS", 4)
    monkeypatch.setattr(s, "SLOT_ROWS", 10)
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(2000) + str(i)) for i in range(600)] + [(1000 + i, "same text") for i in range(300)]
    bytes_of = check(rows, s.shard_documents(docs(rows)).collect(), s.SHARDS)
    assert max(bytes_of) <= 1.02 * sum(bytes_of) / s.SHARDS


def test_differencing_on_two_parts():
    # the textbook case: 8 7 6 5 4 differences to 2
    sums, parts = s.difference([[x, 0] for x in (8, 7, 6, 5, 4)], 2)
    assert sums[0] - sums[1] == 2 and sum(sums) == 30
    rng = random.Random(2)
    for _ in range(50):
        items = [rng.randrange(1, 60) for _ in range(9)]
        sums, parts = s.difference([[x, 0, 0] for x in items], 3)
        assert [sum(items[i] for i, p in part if p == 0) for part in parts] == sums
        best = min(max(sum(x for x, k in zip(items, way, strict=True) if k == j) for j in range(3))
                   for way in itertools.product(range(3), repeat=9)) if len(items) < 9 else max(max(items), -(-sum(items) // 3))
        assert sums[0] <= 1.34 * best


def test_edges(docs):
    rows = [(1, None), (2, ""), (None, ""), (3, "é"), (3, "é"), (4, "z" * 500_000)]
    check(rows, s.shard_documents(docs(rows)).collect(), s.SHARDS)
    assert s.shard_documents(docs([])).count() == 0
