import random

import numpy as np
import pytest

from railpulse.llm import ngram_join as n
from railpulse.llm.components import components

from .conftest import DIRS


def brute(rows):
    """(id, class, links) by comparing all pairs."""
    def grams(t):
        w = (t or "").lower().encode().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    sets = [grams(t) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
                continue
            if not a and not b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), k), k)
    return sorted((k, low[root(i)], links[i]) for i, (k, _) in enumerate(rows))


def test_bands_reach_the_recall():
    assert (1 - 0.8 ** n.ROWS) ** n.BANDS <= n.MAX_MISS


def test_query_equals_all_pairs(spark, documents):
    assert sorted(map(tuple, n.op3_ngram_join(spark, DIRS["small"]).collect())) == brute(documents)


@pytest.fixture
def near_group():
    """A third of the rows: near copies in a chain, with exact copies among them."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    text = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(90):
        if i % 3:
            text = list(text)
            text[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(180)]
    return rows


def test_large_group_in_blocks(docs, near_group, monkeypatch):
    monkeypatch.setattr(n, "BLOCK_CLASSES", 8)
    assert sorted(map(tuple, n.join(docs(near_group)).collect())) == brute(near_group)


def test_edges_and_stage(docs):
    rows = [(1, ""), (2, None), (3, "a b"), (4, "A  b"), (5, "a b c d e f"), (6, "a b c d e f"), (6, "a b c d e f"), (7, "z")]
    assert sorted(map(tuple, n.join(docs(rows)).collect())) == brute(rows)
    df = docs([*rows, (None, "q r s t u v"), (None, "q r s t u v")])
    kept = n.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 1), (False, 3), (False, 5), (False, 7), (True, 0)]
    again = n.keep_one(docs([(6, "a b c d e f"), (6, "a b c d e f")]))
    assert again.count() == 1
    assert n.join(docs([])).count() == 0 and n.keep_one(docs([])).count() == 0


def test_components_of_long_chain(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 102: 100}


def test_overlaps_in_column_blocks(monkeypatch):
    monkeypatch.setattr(n, "COLUMNS", 3)
    rng = np.random.default_rng(1)
    a = [np.unique(rng.integers(0, 30, 20)).astype(np.uint64) for _ in range(6)]
    assert (n.overlaps(a[:4], a[4:]) == [[len(set(x) & set(y)) for y in a[4:]] for x in a[:4]]).all()


def test_equal_ids_do_not_join_unlike_texts(docs):
    rng = random.Random(8)
    x, y, w, v = (" ".join(str(rng.randrange(10 ** 6)) for _ in range(40)) for _ in range(4))
    rows = [(0, x), (1, x), (1, y), (2, w), (2, v), (2, v + " more"), (3, x + " more")]
    got = [tuple(r) for r in n.join(docs(rows)).collect()]
    assert sorted((i, k) for i, _, k in got) == sorted((i, k) for i, _, k in brute(rows))
    names = {i: {c for j, c, _ in got if j == i} for i in range(4)}
    assert names[0] == names[3] == {0} and names[1] == {0, 1} and len(names[2]) == 2 and 2 in names[2]
    kept = sorted((r.doc_id, r.text) for r in n.keep_one(docs(rows)).collect())
    assert kept in (sorted([(0, x), (1, y), (2, w), (2, z)]) for z in (v, v + " more"))
    same = [(7, " ".join(str(rng.randrange(10 ** 6)) for _ in range(20))) for _ in range(40)]
    assert sorted(tuple(r)[:2] for r in n.keep_one(docs(same)).collect()) == sorted(same)


def test_kept_texts_are_not_dealt_again(docs):
    plan = n.keep_one(docs([(i, f"a b c d e f{i}") for i in range(20)] * 2))._jdf.queryExecution().executedPlan().toString()
    by_key = [line for line in plan.splitlines() if "Exchange hashpartitioning(key" in line]
    assert len(by_key) == 1  # of the rows that repeat id and text
