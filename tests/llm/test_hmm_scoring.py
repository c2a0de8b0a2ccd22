import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from railpulse.llm import hmm_scoring as h

from .conftest import DIRS


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def check(rows, got, model):
    """Counts and unigram score by plain counting, the model's by the plain forward recursion."""
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows}
    count = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    assert model.tokens == n and model.words == v
    for i, t in rows:
        r, w = got[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), abs=1e-6)
        total, alpha = 0.0, None
        for x in w:
            c = 0 if x == b"\n" else model.top.get(x) or 1 + h.TOP_WORDS + zlib.crc32(x) % h.HASHED
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[c]
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            if c > h.TOP_WORDS:
                total += math.log10((count[x] + 0.5) / (model.class_count[c] + 0.5 * (model.class_words[c] + 1)))
        assert r.score == pytest.approx(total, abs=1e-6)


@pytest.fixture
def trained(monkeypatch):
    seen = []
    fit = h.train
    monkeypatch.setattr(h, "train", lambda *a: seen.append(fit(*a)) or seen[-1])
    return seen


def test_query_equals_plain_recursion_and_beats_unigrams(spark, documents, trained, monkeypatch):
    monkeypatch.setattr(h, "BUCKET_TOKENS", 100_000)
    got = {r.doc_id: r for r in h.op4_hmm_scoring(spark, DIRS["small"]).collect()}
    assert len(got) == len(documents)
    check(documents, got, trained[0])
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(docs, trained):
    rows = [(1, None), (2, ""), (3, "A a\x0bB  c"), (None, "a b"), (5, "a " * 5000)]
    got = {r.doc_id: r for r in h.score(docs(rows)).collect()}
    check(rows, got, trained[0])
    assert h.score(docs([])).count() == 0
    only_held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    none = h.score(docs([(i, "a b") for i in only_held])).collect()
    assert {r.train_tokens for r in none} == {0} and all(math.isfinite(r.score) for r in none)


def test_expected_counts_equal_enumeration():
    rng = np.random.default_rng(2)
    k = 2
    model = h.Model(np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]]), rng.random((h.CLASSES, k)), {}, np.zeros(h.CLASSES),
                    np.zeros(h.CLASSES))
    runs = [[3, 5, 3, 9], [5, 9]]
    grid = np.zeros((2, h.RUN), int)
    for i, r in enumerate(runs):
        grid[i, :len(r)] = r
    starts, moves, emits = h.expected(model, grid, np.array([4, 2]))
    want = [np.zeros(k), np.zeros((k, k)), np.zeros((h.CLASSES, k))]
    for r in runs:
        paths = {}
        for p in itertools.product(range(k), repeat=len(r)):
            x = model.start[p[0]] * model.emit[r[0], p[0]]
            for a, b, c in zip(p[:-1], p[1:], r[1:], strict=True):
                x *= model.move[a, b] * model.emit[c, b]
            paths[p] = x
        for p, x in paths.items():
            x /= sum(paths.values())
            want[0][p[0]] += x
            for a, b in zip(p[:-1], p[1:], strict=True):
                want[1][a, b] += x
            for s, c in zip(p, r, strict=True):
                want[2][c, s] += x
    for a, b in zip((starts, moves, emits), want, strict=True):
        assert np.allclose(a, b)


def test_training_counts_of_whole_texts(docs, monkeypatch):
    """Equal to plain forward and backward recursions over texts of 1 to 1,000 tokens."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 62, 63, 64, 65, 130, 999)]
    k = h.STATES
    model = h.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.random((h.CLASSES, k)),
                    {w.encode(): 1 + i for i, w in enumerate(words[:20])}, np.zeros(h.CLASSES), np.zeros(h.CLASSES))
    want = [np.zeros((1, k)), np.zeros((k, k)), np.zeros((h.CLASSES, k))]
    for t in texts:
        c = h.classes_of(model.top, h.words_of(t.encode()))
        a, b = [model.start * model.emit[c[0]]], [np.ones(k)]
        for x in c[1:]:
            a.append((a[-1] / a[-1].sum()) @ model.move * model.emit[x])
        for x in c[:0:-1]:
            y = model.move @ (model.emit[x] * b[0])
            b.insert(0, y / y.sum())
        for i, x in enumerate(c):
            g = a[i] * b[i]
            want[2][x] += g / g.sum()
            if not i:
                want[0][0] += g / g.sum()
            else:
                m = a[i - 1][:, None] * model.move * (model.emit[x] * b[i])
                want[1] += m / m.sum()
    assert np.isclose(want[1].sum(), sum(len(t.split()) for t in texts)) and np.isclose(want[0].sum(), len(texts))
    for size in (h.TRAIN_TOKENS, 100):
        monkeypatch.setattr(h, "TRAIN_TOKENS", size)
        got = h.baum_welch_counts(h.coded(docs(list(enumerate(texts))), model.top), model)
        for kind, x in enumerate(want):
            assert np.allclose([got.get((kind, i), np.zeros(k)) for i in range(len(x))], x)


def test_long_and_short_forward_agree():
    rng = np.random.default_rng(3)
    model = h.Model(rng.dirichlet(np.ones(h.STATES)), rng.dirichlet(np.ones(h.STATES), h.STATES), rng.dirichlet(np.ones(h.CLASSES) * 0.01 + 1e-3, h.STATES).T + 1e-9,
                    {}, np.ones(h.CLASSES), np.ones(h.CLASSES))
    lengths = np.array([1, 2, 63, 64, 65, 66, 500, 3000, 1, 129])
    classes = rng.integers(0, h.CLASSES, lengths.sum())
    ends = np.cumsum(lengths)
    short = h.forward_short(model, classes, ends - lengths, ends)
    assert np.allclose(short, h.forward_long(model, classes, ends), rtol=1e-10) and np.isfinite(short).all()
    assert np.allclose(short, h.forward(model, classes, ends))


def test_texts_side_by_side_are_about_equally_long(monkeypatch):
    """Long and short texts in turn: the steps of all groups are few, and no text is lost."""
    monkeypatch.setattr(h, "TRAIN_TOKENS", 1000)
    lengths = [200, 2, 1, 50] * 20 + [3000]
    held = [np.full(n, i, "<u2").tobytes() for i, n in enumerate(lengths)]
    groups = list(h.side_by_side(held))
    assert sorted((int(x[0]), len(x)) for g in groups for x in g) == list(enumerate(lengths))
    assert all(len(g) == 1 or sum(map(len, g)) <= 1000 for g in groups)
    assert [len(x) for g in groups for x in g] == sorted(lengths, reverse=True)
    assert sum(len(g[0]) for g in groups) < 3000 + 5 * 200
    assert list(h.side_by_side([])) == []


def test_scores_come_with_their_ids_whatever_the_lengths(docs, trained):
    rows = [(i, "w " * ((i * 37) % 101) + f"x{i % 7}") for i in range(120)]
    got = {r.doc_id: r for r in h.score(docs(rows)).collect()}
    assert len(got) == len(rows)
    check(rows, got, trained[0])
