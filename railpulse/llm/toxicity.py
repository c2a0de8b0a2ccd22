"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

A word's vector is the sum of three rows of hashed embedding tables (two hashes of the word, one of its
first bytes).  Filters of several widths run over the words of the whole text, the largest response of
each filter feeds a logistic layer.  Only the text is read for a score; the language that picks a
threshold is guessed from function words in it.

The model is fitted on all labelled rows that are not held out, with whole texts, in shards whose models are
averaged after each round; every row is scored.  Null and empty texts
get the score of a text without words; repeated rows get equal scores; null labels are not learned from;
with no label of one of the two kinds every score is 0.  An empty table gives an empty one.
"""

from __future__ import annotations

import copy
import itertools
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import bounded_batches, cut, fold, table, utf8

SHARD = 5000  # texts that one task learns from in a round
LOGIT_STEPS = 1024  # thresholds are found among logits to this part of 1
WORD_ROWS, PREFIX_ROWS, PREFIX_BYTES = 1 << 17, 1 << 15, 4
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, MIN_STEPS, BATCH, RATE, SEED = 6, 600, 32, 0.15, 7
HELD_FOR_THRESHOLDS = 5  # every 5th training row calibrates
MIN_CALIBRATION = 20  # positives; with fewer, a language uses the common threshold, and that all rows
SLICE = 50_000  # words of a text that are in memory at once
CACHE_WORDS = 150_000
MIN_TEXTS = 3  # training texts that must have a word, for it to get a vector
_TAPS = sum(WIDTHS)
_TO_SPACE = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or c < 32 else c for c in range(256))
#: function words that tell a text's language
FUNCTION_WORDS = {
    "en": (b"the", b"and", b"of", b"to", b"with", b"that"),
    "de": (b"der", b"die", b"das", b"und", b"den", b"ist"),
    "fr": (b"le", b"les", b"des", b"est", b"dans", b"pour"),
    "es": (b"el", b"los", b"las", b"del", b"por", b"una"),
}
_LANGUAGE_OF = {w: k for k, ws in FUNCTION_WORDS.items() for w in ws}


def words_of(data: bytes) -> list[bytes]:
    return data.decode().lower().encode().translate(_TO_SPACE).split()


def language(words: list[bytes]) -> str:
    """The language with most function words; ``other`` without any, the first by name in a tie."""
    count: dict[str, int] = {}
    for w in filter(_LANGUAGE_OF.__contains__, words):
        k = _LANGUAGE_OF[w]
        count[k] = count.get(k, 0) + 1
    return min(count, key=lambda k: (-count[k], k)) if count else "other"


def rows_of(words: list[bytes]) -> np.ndarray:
    """Embedding rows (n, 3) of words."""
    n = len(words)
    first = np.fromiter(map(zlib.crc32, words), np.int64, n) % WORD_ROWS
    second = np.fromiter((zlib.crc32(w, 0x5BD1E995) for w in words), np.int64, n) % WORD_ROWS
    prefix = np.fromiter((zlib.crc32(w[:PREFIX_BYTES], 1) for w in words), np.int64, n) % PREFIX_ROWS
    return np.stack([first, WORD_ROWS + second, 2 * WORD_ROWS + prefix], axis=1)


class Kept:
    """What ``make`` gives for words (n, width), made once for a word and kept while there are few."""

    def __init__(self, make: Callable[[list[bytes]], np.ndarray], width: int, dtype, empty: int):
        self.make, self.width, self.dtype, self.empty = make, width, dtype, empty
        self.clear()

    def clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.known = np.zeros((1 << 12, self.width), self.dtype)

    def rows(self, words: list[bytes], pad: int) -> np.ndarray:
        """Rows of the words and ``pad`` empty ones after them."""
        if len(self.seen) > CACHE_WORDS:
            self.clear()
        n = len(words)
        at = np.fromiter(map(self.seen.get, words, itertools.repeat(-1)), np.int64, n)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            first = [words[i] for i in missing.tolist()]
            new, begin = list(dict.fromkeys(first)), len(self.seen)
            while begin + len(new) > len(self.known):
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            self.known[begin:begin + len(new)] = self.make(new)
            self.seen.update(zip(new, range(begin, begin + len(new)), strict=True))
            at[missing] = np.fromiter(map(self.seen.__getitem__, first), np.int64, len(first))
        out = np.full((n + pad, self.width), self.empty, self.dtype)
        np.take(self.known, at, axis=0, out=out[:n], mode="clip")
        return out


@dataclass
class Model:
    """Embeddings (rows, DIM), filters by width (width, DIM, FILTERS), output layer, thresholds by language."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def taps(self) -> np.ndarray:
        """All filters side by side (DIM, taps * FILTERS)."""
        return np.concatenate([w[j] for w in self.filters for j in range(len(w))], axis=1)

    def pooled(self, p: np.ndarray, zeros: int) -> np.ndarray:
        """Largest response of each filter; ``p``: tap responses of the words and ``zeros`` empty positions."""
        n, at, best = len(p) - zeros, 0, []
        for w, b in zip(WIDTHS, self.bias, strict=True):
            h = p[:n, at * FILTERS:(at + 1) * FILTERS]
            for j in range(1, w):
                h = h + p[j:n + j, (at + j) * FILTERS:(at + j + 1) * FILTERS]
            best.append(h.max(0) + b)
            at += w
        return np.maximum(np.concatenate(best), 0)

    def logit(self, pooled: np.ndarray) -> float:
        return float(pooled @ self.out + self.out_bias)


def kept_rows() -> Kept:
    return Kept(rows_of, 3, np.int64, -1)


def sequence(words: list[bytes], kept: Kept | None = None) -> np.ndarray:
    """Embedding rows of a text; -1 stands for the empty positions that end it."""
    return (kept or kept_rows()).rows(words, max(WIDTHS) - 1 + (not words))


SIZE = 2 * WORD_ROWS + PREFIX_ROWS
PAD = max(WIDTHS) - 1


@dataclass
class Training:
    """A model with its squared gradients, for the step sizes; one pass after the other goes on from it."""

    model: Model
    grown: np.ndarray
    squares: list[np.ndarray]
    square_b: float = 1e-6

    @classmethod
    def start(cls) -> Training:
        rng = np.random.default_rng(SEED)
        m = Model(rng.normal(0, 0.1, (SIZE + 1, DIM)).astype(np.float32),
                  [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
                  [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                  rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
        m.embed[SIZE] = 0  # the empty position, at index -1
        return cls(m, np.full(SIZE + 1, 1e-6, np.float32), [np.full_like(p, 1e-6) for p in (*m.filters, *m.bias, m.out)])

    def dense(self) -> np.ndarray:
        """All but the embeddings as one vector."""
        m = self.model
        return np.concatenate([*(p.ravel() for p in (*m.filters, *m.bias, m.out, *self.squares)), [m.out_bias, self.square_b]]).astype(float)

    def set_dense(self, v: np.ndarray) -> None:
        m, at = self.model, 0
        for p in (*m.filters, *m.bias, m.out, *self.squares):
            p[...] = v[at:at + p.size].reshape(p.shape)
            at += p.size
        m.out_bias, self.square_b = float(v[at]), float(v[at + 1])

    def step(self, seqs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        """One step on a batch of texts."""
        m = self.model
        v, won = winners(m, seqs)
        v, on = np.maximum(v, 0), v > 0
        g = weight * (1 / (1 + np.exp(-np.clip(v @ m.out + m.out_bias, -30, 30))) - y) / BATCH
        g = g.astype(np.float32)
        back = g[:, None] * m.out * on
        params = [*m.filters, *m.bias, m.out]
        grads, grad_b, rows, steps = [np.zeros_like(p) for p in params], float(g.sum()), [], []
        grads[-1] += v.T @ g
        for q, w in enumerate(WIDTHS):
            d = back[:, q * FILTERS:(q + 1) * FILTERS]
            grads[len(WIDTHS) + q] += d.sum(0)
            for j in range(w):
                s = won[q][:, j]
                grads[q][j] += np.einsum("bfd,bf->df", m.embed[s].sum(2), d)
                rows.append(s.ravel())
                steps.append(np.repeat((m.filters[q][j].T * d[:, :, None]).reshape(-1, DIM), 3, axis=0))
        for p, g, sq in zip(params, grads, self.squares, strict=True):
            sq += g * g
            p -= RATE * g / np.sqrt(sq)
        self.square_b += grad_b * grad_b
        m.out_bias -= RATE * grad_b / np.sqrt(self.square_b)
        r, g = np.concatenate(rows), np.concatenate(steps)
        r, g = r[g.any(1) & (r >= 0)], g[g.any(1) & (r >= 0)]
        u, back_to = np.unique(r, return_inverse=True)
        total = np.zeros((len(u), DIM), np.float32)
        np.add.at(total, back_to, g)
        self.grown[u] += (total * total).mean(1)
        m.embed[u] -= RATE * total / np.sqrt(self.grown[u])[:, None]

    def end(self) -> Model:
        self.model.embed[self.grown <= 1e-6] = 0  # what no gradient has reached says nothing
        return self.model


def winners(m: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest response of each filter in each text, and by width the embedding rows (text, place, filter, 3) there.

    Long texts are read in slices.
    """
    v = np.full((len(seqs), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    won = [np.full((len(seqs), w, FILTERS, 3), -1, np.int64) for w in WIDTHS]
    group, size = [], 0
    parts = [(i, s[a:a + SLICE + PAD]) for i, s in enumerate(seqs) for a in range(0, len(s) - PAD, SLICE)]
    for at, part in enumerate(parts):
        group.append(part)
        size += len(part[1])
        if size < SLICE and at < len(parts) - 1:
            continue
        s = np.concatenate([x for _, x in group])
        ends = np.cumsum([len(x) for _, x in group])
        begins = np.concatenate([[0], ends[:-1]])
        p, tap = m.embed[s].sum(1) @ m.taps(), 0
        for q, (w, b) in enumerate(zip(WIDTHS, m.bias, strict=True)):
            h = p[:len(p) - PAD, tap * FILTERS:(tap + 1) * FILTERS]
            for j in range(1, w):
                h = h + p[j:j + len(h), (tap + j) * FILTERS:(tap + j + 1) * FILTERS]
            of = slice(q * FILTERS, (q + 1) * FILTERS)
            for (i, _), c, e in zip(group, begins, ends, strict=True):
                k = c + h[c:e - PAD].argmax(0)
                best = h[k, np.arange(FILTERS)] + b
                better = best > v[i, of]
                v[i, of] = np.where(better, best, v[i, of])
                won[q][i][:, better] = s[k[better][None] + np.arange(w)[:, None]]
            tap += w
        group, size = [], 0
    return v, won


def known_rows(s: np.ndarray, rare: np.ndarray) -> np.ndarray:
    return np.where(rare[s], -1, s)  # a word of one text would only be learned by heart


def fit(texts: list[bytes], labels: list[int]) -> Model | None:
    """Train on all but every ``HELD_FOR_THRESHOLDS``-th text of a list, calibrate thresholds on those."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(SEED)
    kept = kept_rows()
    seqs = [sequence(words_of(t), kept) for t in texts]
    langs = [language(words_of(t)) for t in texts]
    texts_with = np.zeros(SIZE + 1, np.int32)
    for s in seqs:
        texts_with[np.unique(s)] += 1
    seqs = [known_rows(s, texts_with < MIN_TEXTS) for s in seqs]
    held = np.arange(len(seqs)) % HELD_FOR_THRESHOLDS == HELD_FOR_THRESHOLDS - 1
    train = np.flatnonzero(~held)
    if len(set(y[train])) < 2:
        train, held = np.arange(len(seqs)), np.ones(len(seqs), bool)
    weight = np.where(y > 0, len(train) / (2 * y[train].sum()), len(train) / (2 * (1 - y[train]).sum()))
    t = Training.start()
    for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // len(train)))):
        rng.shuffle(train)
        for a in range(0, len(train), BATCH):
            batch = train[a:a + BATCH]
            t.step([seqs[i] for i in batch], y[batch], weight[batch])
    m = t.end()
    logits = np.array([m.logit(np.maximum(winners(m, [s])[0][0], 0)) for s in seqs])
    if y[held].sum() < MIN_CALIBRATION:
        held[:] = True
    for lang in ("", *sorted(set(langs))):
        of = held & np.array([lang in ("", x) for x in langs])
        if not lang or MIN_CALIBRATION <= y[of].sum() < of.sum():
            m.thresholds[lang] = threshold(logits[of], y[of])
    return m


def threshold(logits: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The middle of the range of cuts with the fewest errors, false alarms counted twice; ``n``: texts of each logit."""
    n = np.ones(len(y)) if n is None else n
    if not 0 < (n * y).sum() < n.sum():
        return 0.0
    order = np.argsort(logits)
    s, t, c = logits[order], (n * y)[order], (n * (1 - y))[order]
    missed = np.concatenate([[0], np.cumsum(t)])
    alarms = np.concatenate([[c.sum()], c.sum() - np.cumsum(c)])
    cost = missed + 2 * alarms
    edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    best = np.flatnonzero(cost == cost.min())
    return float((edges[best[0]] + edges[best[-1]]) / 2)


class Scorer:
    """Scores texts with a model; tap responses of words are computed once and kept while few."""

    def __init__(self, model: Model | None):
        self.model = model
        if model is not None:
            w = model.taps()
            self.kept = Kept(lambda new: model.embed[rows_of(new)].sum(1) @ w, _TAPS * FILTERS, np.float32, 0)

    def score(self, data: bytes) -> float:
        m = self.model
        if m is None:
            return 0.0
        words = words_of(data)
        best, pad = None, max(WIDTHS) - 1
        for a in range(0, max(1, len(words)), SLICE):
            part = words[a:a + SLICE + pad]
            follow = min(pad, max(0, len(words) - a - SLICE))  # words of the next slice that windows reach into
            v = m.pooled(self.kept.rows(part, pad - follow + (not part)), pad)
            best = v if best is None else np.maximum(best, v)
        cut = m.thresholds.get(language(words), m.thresholds[""])
        return float(1 / (1 + np.exp(-np.clip(m.logit(best) - cut, -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_id, _y, _text) of all labelled rows that are learned from: held-out ids never are."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).select(
        F.col("doc_id").alias("_id"), F.col("toxic").alias("_y"))
    own = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where(
        F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    shards = max(1, -(-marks.distinct().count() // SHARD))
    # Texts are dealt once: the join keeps the shards.  Would it read two plain exchanges, Spark might give it other partitions.
    return own.repartition(shards, "_id").join(marks.repartition(shards, "_id").distinct(), "_id")


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[int]]:
    """A bounded look at the training rows; nothing is learned from it."""
    got = training_rows(docs, labels).orderBy(F.xxhash64("_id", F.lit(SEED)), "_text", "_y").limit(SHARD).collect()
    return [r["_text"].encode() for r in got], [r["_y"] for r in got]


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model fitted on all training rows, with whole texts.

    Rows are dealt by id into shards of about ``SHARD`` texts.  In each round every shard goes on from the common
    state, and what it has changed is averaged: an embedding row over the shards that have reached it.  A single
    shard makes all its passes in one round.  Counts of words and the thresholds come from all rows as well, the
    latter from exact counts of logits to 1 / ``LOGIT_STEPS``.  What reaches the driver is bounded by the size of the model.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(HELD_FOR_THRESHOLDS)) == HELD_FOR_THRESHOLDS - 1
    order = F.xxhash64("_id", "_text", F.lit(SEED))
    rows = cut(training_rows(docs, labels).select("_id", F.col("_y").cast("int").alias("_y"), held.alias("_held"), "_text")
               .sortWithinPartitions(order, "_id", "_text", "_y"))
    n = {(r["_y"], r["_held"]): r["count"] for r in rows.groupBy("_y", "_held").count().collect()}  # four rows at most
    count = lambda y, *of: sum(n.get((y, h), 0) for h in of)
    if not count(0, True, False) or not count(1, True, False):
        return None
    both = (True, False)
    learn = (False,) if count(0, False) and count(1, False) else both
    calibrate = (True,) if learn != both and count(1, True) >= MIN_CALIBRATION else both
    y1, y0 = count(1, *learn), count(0, *learn)
    weights = np.array([(y0 + y1) / (2 * y0), (y0 + y1) / (2 * y1)])

    def words_with(batches):
        seen, kept = np.zeros(SIZE, np.int64), kept_rows()
        for batch in batches:
            for text in utf8(batch.column(3)):
                seen[np.unique(kept.rows(words_of(text), 0))] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["row", "n"])

    common = rows.mapInArrow(words_with, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TEXTS)
    rare = np.ones(SIZE + 1, bool)
    rare[common.select("row").toArrow()["row"].to_numpy()] = False  # at most the rows of the embedding
    alone = rows.rdd.getNumPartitions() == 1
    epochs = max(EPOCHS, -(-MIN_STEPS * BATCH // (y0 + y1)))
    rounds, passes = (1, epochs) if alone else (EPOCHS, -(-epochs // EPOCHS))
    mine = rows.where(F.col("_held").isin(*learn))
    t = Training.start()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((t, rare))
        changes = mine.mapInArrow(lambda batches, shared=shared: one_round(batches, shared.value, weights, passes),
                                  "row int, v array<float>")
        total = changes.groupBy("row").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM + 1)], F.count("*").alias("n"))
        # Rows of the model: as Arrow columns, since a Python object for each number would take many times as much.
        got = total.toArrow()
        shared.destroy()
        at, times = got["row"].to_numpy(), got["n"].to_numpy()
        got = np.column_stack([at, *(got[f"v{i}"].to_numpy() / times for i in range(DIM + 1))])
        words = at < SIZE
        t.model.embed[at[words]] += got[words, 1:1 + DIM].astype(np.float32)
        t.grown[at[words]] += got[words, 1 + DIM].astype(np.float32)
        rest = got[~words][np.argsort(at[~words])][:, 1:]
        dense = t.dense()
        if len(rest):
            t.set_dense(dense + rest.reshape(2, -1).sum(0)[:len(dense)])
    m = t.end()
    ready = spark.sparkContext.broadcast((m, rare))

    def logits(batches):
        (m, rare), kept = ready.value, kept_rows()
        for batch in batches:
            marks = [(language(w), round(LOGIT_STEPS * m.logit(np.maximum(winners(m, [known_rows(sequence(w, kept), rare)])[0][0], 0))))
                     for w in map(words_of, utf8(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in marks], pa.string()), pa.array([x for _, x in marks], pa.int64()),
                                              batch.column(1)], names=["lang", "at", "y"])

    within = F.greatest(F.least("at", F.lit(30 * LOGIT_STEPS)), F.lit(-30 * LOGIT_STEPS)).alias("at")  # scores are cut there as well
    found = rows.where(F.col("_held").isin(*calibrate)).mapInArrow(logits, "lang string, at long, y int") \
        .groupBy("lang", within, "y").count().collect()  # bounded by languages and steps
    ready.destroy()
    langs = np.array([r["lang"] for r in found])
    at, y, c = (np.array([r[k] for r in found], float) for k in ("at", "y", "count"))
    for lang in ("", *sorted(set(langs))):
        of = (langs == lang) | (lang == "")
        if not lang or MIN_CALIBRATION <= (c * y)[of].sum() < c[of].sum():
            m.thresholds[lang] = threshold(at[of] / LOGIT_STEPS, y[of], c[of])
    return m


def one_round(batches, state: tuple[Training, np.ndarray], weights: np.ndarray, passes: int):
    """What ``passes`` over a shard change: (row, changes of its vector and squares), the rest of the model after them."""
    base, rare = state
    t = copy.deepcopy(base)
    rng, held, kept = np.random.default_rng(SEED), [], kept_rows()

    def steps(texts):
        seqs, y = [s for s, _ in texts], np.array([y for _, y in texts])
        t.step(seqs, y, weights[y])

    waiting: list = []
    for batch in batches:
        for text, y in zip(utf8(batch.column(3)), batch.column(1).to_pylist(), strict=True):
            one = (known_rows(sequence(words_of(text), kept), rare), y)
            if passes > 1:
                held.append(one)
                continue
            waiting.append(one)
            if len(waiting) == BATCH:
                steps(waiting)
                waiting = []
    if waiting:
        steps(waiting)
    order = np.arange(len(held))
    for _ in range(passes if held else 0):
        rng.shuffle(order)
        for a in range(0, len(order), BATCH):
            steps([held[i] for i in order[a:a + BATCH]])
    at = np.flatnonzero(t.grown[:SIZE] != base.grown[:SIZE])
    if not len(at):
        return
    rows = np.column_stack([t.model.embed[at] - base.model.embed[at], t.grown[at] - base.grown[at]])
    dense = t.dense() - base.dense()
    dense = np.concatenate([dense, np.zeros(-len(dense) % (DIM + 1))]).reshape(-1, DIM + 1)
    high = dense.astype(np.float32)  # and what that leaves, so that two floats hold it
    dense = np.concatenate([high, (dense - high).astype(np.float32)])
    at, rows = np.concatenate([at, SIZE + np.arange(len(dense))]), np.concatenate([rows, dense])
    for a in range(0, len(at), 10_000):
        part = rows[a:a + 10_000]
        v = pa.ListArray.from_arrays(np.arange(0, part.size + 1, DIM + 1, dtype=np.int32), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at[a:a + 10_000].astype(np.int32)), v], names=["row", "v"])


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by the constants above
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            s = [scorer.score(x) for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())],
                names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns as they were."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(x) < 0.5 for x in utf8(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    got = scores(docs, model)
    return got.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
