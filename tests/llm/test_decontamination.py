import random

import numpy as np

from railpulse.llm import decontamination as d

from .conftest import DIRS


def test_query_equals_containment(spark, documents):
    """The table's passages are exact, so word for word containment is the brute force."""
    items = [tuple(r) for r in spark.read.parquet(f"{DIRS['small']}/benchmark.parquet").collect()]
    plain = [(i, b" " + b" ".join(d.words_of(t.encode())) + b" ") for i, t in documents]
    want = {(i, k) for k, t in items for i, x in plain if b" " + b" ".join(d.words_of(t.encode())) + b" " in x}
    got = d.op10_decontamination(spark, DIRS["small"]).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 0


def world():
    rng = random.Random(3)
    common = [f"c{i}" for i in range(40)]
    rare = [f"r{i}" for i in range(4000)]
    say = lambda n: [rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n)]
    items = [(k, " ".join(say(24)) + ". Answer is " + " ".join(say(4)) + ".") for k in range(12)]
    items.append((99, " ".join(say(200))))
    docs = [(i, " ".join(say(rng.choice((30, 150, 600))))) for i in range(150)]
    put = lambda text, item: " ".join(say(37)) + " " + text(d.words_of(item.encode())) + " " + " ".join(say(120))
    exact = lambda w: b" ".join(w).decode().upper()
    docs += [(1000 + k, put(exact, t)) for k, t in items]

    def paraphrase(w):  # a third of the question's words replaced, the answer kept
        out = [x if i % 3 or i >= 20 else f"new{i}".encode() for i, x in enumerate(w)]
        return b" ".join(out).decode()
    docs += [(2000 + k, put(paraphrase, t)) for k, t in items if k < 99]
    return docs, items


def test_exact_long_and_paraphrased(spark, docs):
    rows, items = world()
    got = d.contaminated(docs(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1000 + k, k) for k, _ in items} | {(2000 + k, k) for k, _ in items if k < 99}


def test_blocks_of_the_benchmark_change_nothing(spark, docs, monkeypatch):
    rows, items = world()
    monkeypatch.setattr(d, "BLOCK_PARTS", 5)
    got = d.contaminated(docs(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1000 + k, k) for k, _ in items} | {(2000 + k, k) for k, _ in items if k < 99}


def test_distributed_svd_equals_numpy(spark, docs):
    rows, items = world()
    parts = [p for k, t in items for p in d.parts_of(k, t)]
    words = list(dict.fromkeys(w for p in parts for w in p.words))
    ix = d.Index({w: i for i, w in enumerate(words)}, np.linspace(0.5, 2, len(words)).astype(np.float32), np.zeros((0, 0)))
    a = []
    for _, t in rows:
        w = d.words_of(t.encode())
        for s in range(0, len(w), d.PASSAGE):
            v = np.zeros(len(words))
            v[[ix.at[x] for x in set(w[s:s + d.PASSAGE]) if x in ix.at]] = 1
            a.append(v * ix.weight)
    own = np.random.default_rng(1).random((3, len(words)))
    x = np.random.default_rng(2).normal(size=(len(words), 5))
    full = np.concatenate([np.array(a), own])
    assert np.allclose(d.gram_product(docs(rows), ix, own, x), full.T @ (full @ x), rtol=1e-3, atol=1e-2)
    df, n = d.document_frequencies(docs(rows), ix)
    assert n == len(a) and (df == (np.array(a) > 0).sum(0)).all()


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd").encode() for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert d.common(a, b) == t[-1][-1]


def test_edges(spark, docs):
    rows, items = world()
    bench = spark.createDataFrame([*items[:2], items[0], (5, ""), (6, None), (None, "x y")], "item_id bigint, text string")
    leak = items[0][1]
    df = docs([(1, None), (2, ""), (3, leak), (3, leak), (None, leak), *rows[:20]])
    assert sorted((r.doc_id or -1, r.item_id) for r in d.contaminated(df, bench).collect()) == [(-1, 0), (3, 0)]
    kept = d.keep_uncontaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == 22
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.contaminated(df, none).count() == 0 and d.contaminated(docs([]), bench).count() == 0
    assert d.keep_uncontaminated(df, none).count() == df.count()


def test_copies_of_short_items(spark, documents, monkeypatch):
    """Many more items than the latent space has dimensions, cut from the documents: each is found where it was cut."""
    monkeypatch.setattr(d, "RANK", 16)
    rng, items, source = random.Random(6), [], {}
    for k, (i, t) in enumerate(rng.sample([x for x in documents if x[1] and len(d.words_of(x[1].encode())) > 80], 500)):
        words, n = d.words_of(t.encode()), (5, 5, 8, 10, 50)[k % 5]
        at = rng.randrange(len(words) - n)
        items.append((k, b" ".join(words[at:at + n]).decode()))
        source[k] = i
    frame = spark.read.parquet(f"{DIRS['small']}/documents.parquet")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert {(i, k) for k, i in source.items()} <= got


def test_items_without_an_id(spark, docs):
    rows, items = world()
    bench = spark.createDataFrame([(None, items[0][1]), (None, items[1][1]), items[2]], "item_id bigint, text string")
    df = docs([r for r in rows if r[0] < 2000])
    got = sorted((r.doc_id, r.item_id or -1) for r in d.contaminated(df, bench).collect())
    assert got == [(1000, -1), (1001, -1), (1002, 2)]
    assert d.keep_uncontaminated(df, bench).count() == df.count() - 3


def test_known_words_of_a_batch_equal_single_look_ups():
    words = [b"the", b"caf\xc3\xa9", b"x\xc2\xa0y", b"q"]
    ix = d.Index({w: i for i, w in enumerate(words)}, np.array([0, 1, 2, 3], np.float32), np.zeros((0, 0)))
    texts = ["", "  ", "The,cafÉ", "\x0b q\x0c\x00q ", "x y x y", " the ", "none here", "!the q?\n"]
    data = [t.encode() for t in texts]
    for heavy in (False, True):
        text, where, ids, n = ix.known(data, heavy)
        split = [d.words_of(x) for x in data]
        want = [(i, k, ix.at[w]) for i, ws in enumerate(split) for k, w in enumerate(ws) if w in ix.at and (not heavy or ix.at[w])]
        assert list(zip(text.tolist(), where.tolist(), ids.tolist(), strict=True)) == want
        assert n.tolist() == [len(ws) for ws in split]
    assert [len(x) for x in ix.known([])] == [0, 0, 0, 0]


def test_spans_keep_equal_rows_together():
    row = np.array([0, 0, 1, 1, 1, 1, 2, 5, 5])
    got = d.spans(row, 2)
    assert [b for _, b in got] == [*[a for a, _ in got[1:]], len(row)] and got[0][0] == 0
    assert all(row[b - 1] != row[b] for _, b in got[:-1]) and d.spans(row[:0], 2) == []


def test_sums_of_rows_by_key(monkeypatch):
    rng = np.random.default_rng(4)
    vectors, index, keys = rng.random((9, 3)), rng.integers(0, 9, 60), np.sort(rng.choice([2, 3, 5, 11], 60, p=[0.7, 0.1, 0.1, 0.1]))
    for many in (256, 10, 0):
        monkeypatch.setattr(d, "MANY", many)
        at, got = d.sums(vectors, index, keys)
        assert at.tolist() == sorted(set(keys.tolist()))
        assert np.allclose(got, [vectors[index[keys == k]].sum(0) for k in at])
    assert [x.tolist() for x in d.ranges(np.array([4, 7, 2]), np.array([6, 7, 5]))] == [[0, 0, 2, 2, 2], [4, 5, 2, 3, 4]]
    assert [x.tolist() for x in d.entries(np.array([1, 0, 1, 1]), np.array([2, 3, 0, 2]), 4)] == [[0, 1, 1], [3, 0, 2]]
    assert [len(x) for x in d.entries(np.zeros(0, int), np.zeros(0, int), 4)] == [0, 0]


def test_small_tables_of_candidates_find_the_same(spark, docs, monkeypatch):
    """Texts of a batch are searched together; a candidate's words are counted in its own text, in tables of any size."""
    rows, items = world()
    parts = [p for k, t in items for p in d.parts_of(k, t)]
    frame = docs(rows)
    index = d.build(frame.select("text"), parts)
    found = []
    for cells in (d.CELLS, 1):
        monkeypatch.setattr(d, "CELLS", cells)
        found.append(sorted((r.doc_id, r.item_id, r.shared, r.answer, round(r.cosine, 4)) for r in d.search(frame, parts, index, "doc_id", "text").collect()))
    assert found[0] == found[1]
    assert {x[:2] for x in found[0]} == {(1000 + k, k) for k, _ in items} | {(2000 + k, k) for k, _ in items if k < 99}
