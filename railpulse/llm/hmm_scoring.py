"""Language-model scoring with a hidden Markov model over word classes.

Counts come from all training rows.  The ``TOP_WORDS`` most frequent words are classes of their own, the
others share hashed classes; a word's probability within its class is its smoothed count.  Latent states
are trained by Baum-Welch: every partition adds up expected counts over its whole training texts, many side
by side, Spark sums them, the driver holds only the model of fixed size.  A text's score is the
scaled forward recursion over all its tokens, its end included: the log10 of its exact likelihood.

For the lookup of counts every bucket of documents asks for each of its distinct words once, the answers
come back to the bucket, and its texts are scored there; the vocabulary is never in one place.

A null text is an empty one and has its end as only token.  A null id counts as the empty text in the
fold.  Repeated rows get equal scores and each counts in training.  An empty table gives an empty one;
without training rows every count is 0.  Other columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import bounded_batches, cut, fold, table, utf8

END = "\n"  # the token that ends a text; words hold no white space
HELD_OUT = 1
TOP_WORDS, HASHED = 1023, 1024
CLASSES = 1 + TOP_WORDS + HASHED  # class 0: the end
STATES, ITERATIONS, RUN, SEED = 6, 4, 64, 11
SMOOTH = 0.1
BUCKET_TOKENS = 2_000_000
TRAIN_TOKENS = 500_000  # tokens of texts that are trained on side by side, or one text
HELD = 8  # times as many are held, two bytes each, and put side by side by length
LONG_TEXT = 50_000  # tokens of a text that is scored by transfer matrices
COUNTER_WORDS = 400_000  # distinct words a task counts before it passes them on


def words_of(data: bytes) -> list[bytes]:
    return data.lower().split()  # of bytes: A-Z, and space and \\x09-\\x0D, nothing else


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over the texts of ``rows`` (text), with a row for the end of texts."""
    def run(batches):
        count: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()).cast(pa.string()),
                                               pa.array(count.values(), pa.int64())], names=["word", "c"])
            count.clear()
            return made

        for batch in batches:
            for data in utf8(batch.column(0)):
                count.update(words_of(data))
                if len(count) > COUNTER_WORDS:
                    yield out()
            count[END.encode()] += batch.num_rows
        yield out()

    return rows.select("text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def numbers(found: dict[bytes, int], words: list[bytes], missing: int) -> np.ndarray:
    """The words' values in a dictionary."""
    return np.fromiter(map(found.get, words, itertools.repeat(missing)), np.int64, len(words))


def hashed(words: list[bytes]) -> np.ndarray:
    """Classes of words that are not top words."""
    return 1 + TOP_WORDS + np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % HASHED


def classes_of(top: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    """Classes of words and of the end after them."""
    out = numbers(top, words, -1)
    rare = out < 0
    out[rare] = hashed(list(itertools.compress(words, rare.tolist())))
    return np.append(out, 0)


@dataclass
class Model:
    """Start (states), transitions (states, states), emissions of classes (classes, states); corpus figures."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    top: dict[bytes, int]
    class_count: np.ndarray
    class_words: np.ndarray
    tokens: int = 0
    words: int = 0
    ends: int = 0

    def within(self, classes: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of the words' probabilities within their classes."""
        p = (c + 0.5) / (self.class_count[classes] + 0.5 * (self.class_words[classes] + 1))
        return np.where(classes <= TOP_WORDS, 0.0, np.log10(p))


def expected(model: Model, classes: list[np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions over texts of classes (of which the first ``lengths`` count), longest first."""
    n, k = int(lengths.sum()), len(model.start)
    begins = np.cumsum(lengths) - lengths
    place = np.arange(n) - np.repeat(begins, lengths)
    # the texts' first tokens, then their second ones, and so on; of every table a row is a state
    c = np.concatenate([x[:m] for x, m in zip(classes, lengths, strict=True)])[np.argsort(place, kind="stable")]
    active = np.bincount(place)
    at = np.concatenate([[0], np.cumsum(active)]).tolist()
    e = np.take(np.ascontiguousarray(model.emit.T), c, axis=1)
    alpha, scale = np.empty((k, n)), np.empty(n)
    back = np.ascontiguousarray(model.move.T)
    for t in range(len(active)):
        x, y = at[t], at[t + 1]
        a = (model.start[:, None] if t == 0 else back @ alpha[:, at[t - 1]:at[t - 1] + y - x]) * e[:, x:y]
        np.divide(a, np.add.reduce(a, 0, out=scale[x:y]), out=alpha[:, x:y])
    e /= scale
    beta = np.ones((k, n))
    for t in range(len(active) - 1, 0, -1):
        x, y = at[t], at[t + 1]
        e[:, x:y] *= beta[:, x:y]
        beta[:, at[t - 1]:at[t - 1] + y - x] = model.move @ e[:, x:y]
    before = np.arange(at[1], n) - np.repeat(active[:-1], active[1:])
    moves = model.move * (np.take(alpha, before, axis=1) @ e[:, at[1]:].T)
    gamma = np.multiply(alpha, beta, out=beta)
    gamma /= gamma.sum(0)
    emits = np.stack([np.bincount(c, g, CLASSES) for g in gamma], 1)
    return gamma[:, :at[1]].sum(1), moves, emits


def coded(rows: DataFrame, top: dict[bytes, int]) -> DataFrame:
    """(classes): the classes of each text of ``rows`` (text) as 16-bit integers, written in the shared folder."""
    shared = rows.sparkSession.sparkContext.broadcast(top)  # TOP_WORDS words

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([classes_of(shared.value, words_of(x)).astype("<u2").tobytes()
                                                        for x in utf8(batch.column(0))], pa.binary())], names=["classes"])

    return cut(rows.select("text").mapInArrow(run, "classes binary"))


def side_by_side(held: list[bytes]) -> Iterator[list[np.ndarray]]:
    """Coded texts, longest first, so that those of a group are about equally long; a group has ``TRAIN_TOKENS`` or one text."""
    held = sorted(held, key=len, reverse=True)
    ends = np.cumsum([0, *(len(x) // 2 for x in held)])
    a = 0
    while a < len(held):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + TRAIN_TOKENS, "right")) - 1)
        yield [np.frombuffer(x, "<u2").astype(np.int64) for x in held[a:b]]
        a = b


def baum_welch_counts(rows: DataFrame, model: Model) -> dict[tuple[int, int], np.ndarray]:
    """Expected counts over the texts of ``rows`` (classes): (kind, index) -> a value for each state."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    columns = [f"s{i}" for i in range(STATES)]

    def run(batches):
        m = shared.value
        total = [np.zeros((1, STATES)), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))]

        def add(held: list[bytes]) -> None:
            for texts in side_by_side(held):
                for t, x in zip(total, expected(m, texts, np.array([len(x) for x in texts])), strict=True):
                    t += x

        held, n = [], 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(data)
                n += len(data) // 2
                if n > HELD * TRAIN_TOKENS:
                    add(held)
                    held, n = [], 0
        add(held)
        kind = np.repeat([0, 1, 2], [len(t) for t in total])
        index = np.concatenate([np.arange(len(t)) for t in total])
        every = np.concatenate(total)
        some = every.any(1)
        yield pa.RecordBatch.from_arrays([pa.array(kind[some], pa.int32()), pa.array(index[some], pa.int32()),
                                          *(pa.array(every[some, s]) for s in range(STATES))], names=["kind", "at", *columns])

    parts = rows.select("classes").mapInArrow(run, "kind int, at int, " + ", ".join(f"{c} double" for c in columns))
    summed = parts.groupBy("kind", "at").agg(*(F.sum(c).alias(c) for c in columns)).collect()  # CLASSES + STATES + 1 rows
    return {(r["kind"], r["at"]): np.array([r[c] for c in columns]) for r in summed}


def train(rows: DataFrame, counts: DataFrame) -> Model:
    """Fit on all texts of ``rows`` (text); ``counts``: their (word, c)."""
    spark = rows.sparkSession
    top = [r["word"] for r in counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(TOP_WORDS).collect()]
    first = spark.createDataFrame([(END, 0), *((w, 1 + i) for i, w in enumerate(top))], "word string, class int")
    rest = F.lit(1 + TOP_WORDS) + F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(HASHED))
    of_class = counts.join(F.broadcast(first), "word", "left").groupBy(  # TOP_WORDS + 1 rows
        F.coalesce("class", rest).cast("int").alias("class")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    class_count, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in of_class:
        class_count[r["class"]], class_words[r["class"]] = r["c"], r["n"]
    rng = np.random.default_rng(SEED)
    share = (class_count + SMOOTH) / (class_count + SMOOTH).sum()
    emit = share[:, None] * np.exp(rng.normal(0, 0.7, (CLASSES, STATES)))
    model = Model(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.15 / (STATES - 1)) + np.eye(STATES) * (
        0.85 - 0.15 / (STATES - 1)), emit / emit.sum(0), {w.encode(): 1 + i for i, w in enumerate(top)},
        class_count, class_words, int(class_count.sum()), int(class_words.sum()), int(class_count[0]))
    texts = coded(rows, model.top) if model.tokens else rows
    for _ in range(ITERATIONS if model.tokens else 0):
        got = baum_welch_counts(texts, model)
        none = np.zeros(STATES)
        start = got.get((0, 0), none) + SMOOTH
        move = np.stack([got.get((1, i), none) for i in range(STATES)]) + SMOOTH
        emit = np.stack([got.get((2, c), none) for c in range(CLASSES)]) + SMOOTH * share[:, None]
        model.start, model.move, model.emit = start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)
    return model


def forward(model: Model, classes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log10 of the likelihoods of sequences of classes that lie end to end in ``classes``."""
    begins = np.concatenate([[0], ends[:-1]])
    long = ends - begins > LONG_TEXT
    out = np.empty(len(ends))
    out[~long] = forward_short(model, classes, begins[~long], ends[~long])
    for i in np.flatnonzero(long):
        out[i] = forward_long(model, classes[begins[i]:ends[i]], ends[i:i + 1] - begins[i])[0]
    return out


def forward_short(model: Model, classes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The forward vectors of many sequences are stepped side by side, longest first, scaled all along."""
    order = np.argsort(begins - ends, kind="stable")
    begins, length = begins[order], (ends - begins)[order]
    total = np.zeros(len(order))
    if len(order):
        alpha = model.start * model.emit[classes[begins]]
        active = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right").tolist()  # sequences that have a t-th token
        for t in range(1, len(active)):
            n = active[t]
            a = (alpha[:n] @ model.move) * model.emit[classes[begins[:n] + t]]
            if t % 8 == 0:
                s = a.sum(1)
                a /= s[:, None]
                total[:n] += np.log10(s)
            alpha[:n] = a
        total += np.log10(alpha.sum(1))
    out = np.empty(len(order))
    out[order] = total
    return out


def forward_long(model: Model, classes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each sequence after its first token is cut into pieces of ``RUN``; the pieces' transfer matrices are
    computed side by side and then applied in order, scaled all along.
    """
    k = len(model.start)
    begins = np.concatenate([[0], ends[:-1]])
    alpha = model.start * model.emit[classes[begins]]
    total = np.log10(alpha.sum(1))
    alpha /= alpha.sum(1, keepdims=True)
    rest = ends - begins - 1
    per = -(-rest // RUN)
    owner = np.repeat(np.arange(len(ends)), per)
    rank = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    at = begins[owner] + 1 + rank * RUN
    length = np.minimum(RUN, ends[owner] - at)
    matrix = np.empty((len(at), k, k))
    logs = np.zeros(len(at))
    order = np.argsort(-length, kind="stable")
    for i in range(0, len(order), 8192):
        part = order[i:i + 8192]
        m = np.broadcast_to(np.eye(k), (len(part), k, k)).copy()
        scale = np.zeros(len(part))
        for t in range(int(length[part[0]])):
            n = int((length[part] > t).sum())
            x = (m[:n].reshape(-1, k) @ model.move).reshape(n, k, k) * model.emit[classes[at[part[:n]] + t]][:, None, :]
            if t % 8 == 7:
                s = x.sum((1, 2))
                x /= s[:, None, None]
                scale[:n] += np.log10(s)
            m[:n] = x
        matrix[part], logs[part] = m, scale
    first = np.cumsum(per) - per
    by_pieces = np.argsort(-per, kind="stable")
    for r in range(int(per.max()) if len(per) else 0):
        on = by_pieces[:int((per > r).sum())]
        piece = first[on] + r
        a = np.einsum("nk,nkj->nj", alpha[on], matrix[piece])
        s = a.sum(1)
        alpha[on] = a / s[:, None]
        total[on] += np.log10(s) + logs[piece]
    return total


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (fold(F.col(id_col)) == HELD_OUT).alias("held_out"))
    training = own.where(~F.col("held_out")).select("text")
    counts = cut(word_counts(training))
    model = train(training, counts)
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by the constants above
    buckets = max(1, round(1.25 * model.tokens / BUCKET_TOKENS))
    dealt = own.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int")).repartition(buckets, "bucket")

    def ask(batches):
        seen: dict[int, set[bytes]] = {}
        known = shared.value.top

        def out():
            for b, words in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), b, np.int32)),
                                                  pa.array(list(words), pa.binary()).cast(pa.string())], names=["bucket", "word"])
            seen.clear()

        for batch in batches:
            for b, data in zip(batch.column(3).to_pylist(), utf8(batch.column(1)), strict=True):
                seen.setdefault(b, set()).update(set(words_of(data)).difference(known))
            if sum(map(len, seen.values())) > 2 * COUNTER_WORDS:
                yield from out()
        yield from out()

    answers = dealt.mapInArrow(ask, "bucket int, word string").join(counts, "word").select("bucket", "word", "c")

    def work(texts: pa.Table, known: pa.Table) -> pa.Table:
        m = shared.value
        # one look-up gives a word's class and its count; the class of a top word has that word alone
        asked = known.column("word").cast(pa.binary()).to_pylist()
        at = dict(zip(itertools.chain(m.top, asked), itertools.count()))
        class_of = np.concatenate([np.fromiter(m.top.values(), np.int64, len(m.top)), hashed(asked)])
        count_of = np.concatenate([m.class_count[class_of[:len(m.top)]], np.asarray(known.column("c"))]).astype(float)
        base = -np.log10(m.tokens + 0.5 * (m.words + 1))
        cols: list[list] = [[], [], [], []]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            classes = np.concatenate([x[0] for x in held])
            c = np.concatenate([x[1] for x in held])
            ends = np.cumsum([len(x[0]) for x in held])
            starts = np.concatenate([[0], ends[:-1]])
            cols[0].extend((ends - starts).tolist())
            cols[1].extend(np.add.reduceat((c > 0).astype(np.int64), starts).tolist())
            cols[2].extend(np.add.reduceat(np.log10(c + 0.5) + base, starts).tolist())
            cols[3].extend((forward(m, classes, ends) + np.add.reduceat(m.within(classes, c), starts)).tolist())
            held.clear()

        n = 0
        every = utf8(texts.column("text"))
        by_length = sorted(range(len(every)), key=lambda i: -len(every[i]))  # a step of the recursion then moves many
        for data in map(every.__getitem__, by_length):
            words = words_of(data)
            i = numbers(at, words, -1)
            new = i < 0  # held-out words that training texts do not have
            classes, c = class_of[i] if len(class_of) else np.zeros(len(i), np.int64), count_of[i] if len(count_of) else np.zeros(len(i))
            classes[new], c[new] = hashed(list(itertools.compress(words, new.tolist()))), 0
            held.append((np.append(classes, 0), np.append(c, m.ends)))
            n += len(words) + 1
            if n > 500_000:
                flush()
                n = 0
        if held:
            flush()
        ids = texts.select(["id", "held_out"]).take(pa.array(by_length, pa.int64()))
        return pa.table([ids.column("id"), ids.column("held_out"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                         pa.array([m.tokens] * len(cols[0]), pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())],
                        names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
        work, f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
              "base_score double, score double")


def op4_hmm_scoring(spark, sf_dir: str) -> DataFrame:
    """Unigram and hidden Markov scores of every text of ``documents``."""
    return score(table(spark, sf_dir, "documents"))
