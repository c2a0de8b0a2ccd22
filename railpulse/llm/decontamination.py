"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages of ``PASSAGE`` words.  Over the words of the benchmark, passages and items
make a TF-IDF matrix A; a randomised SVD gives its leading right singular vectors: every partition adds up
its share of A'(A X), Spark sums the shares, the driver orthogonalises.  A passage is a candidate for an
item if, in the latent space, their cosine and the share of the item that the passage covers are large
enough.  So is one that has, with what lies beside it, all words of the item: the latent space keeps little
of a short item, and no copy may be lost by that.  Candidates are settled on the words: the longest common
subsequence of item and passage, or a shorter one together with the item's answer (its last sentence), which
catches paraphrases.

The benchmark is the query set; it is read in blocks of ``BLOCK_PARTS`` parts (long items have several),
each block against all rows, so what is broadcast is bounded.  A result row is a (document, item) pair.
Null and empty texts contain nothing, items without words are found nowhere.  Repeated documents each give
their rows, repeated item ids give one, all items without an id together one with a null id.  Empty tables give an empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import bounded_batches, map_batches, row_key, runs, table, utf8, wrapped

PASSAGE, STRIDE = 64, 32
BLOCK_PARTS = 2000
RANK, SEED = 128, 5
MAX_SHARE = 0.02  # words in a larger share of the passages weigh nothing, unless among the rarest of a part
RAREST = 3
SPAN = 20_000  # entries that are multiplied at once
MANY = 256  # entries of a word that are added up on their own
CELLS = 20_000_000  # of a table of regions and words; of candidates and their words, a tenth
MIN_COSINE, MIN_COVER = 0.30, 0.35
FULL, PARTIAL, ANSWER = 0.75, 0.55, 0.8
_TO_SPACE = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or c < 32 else c for c in range(256))


def _plain(data: bytes) -> bytes:
    low = data.lower() if data.isascii() else data.decode().lower().encode()
    return low.translate(_TO_SPACE)


def words_of(data: bytes) -> list[bytes]:
    return _plain(data).split()


def answer_of(text: str) -> list[bytes]:
    """The words of the last sentence that has any."""
    for sentence in reversed(re.split(r"[.?!:\n]", text)):
        if w := words_of(sentence.encode()):
            return w
    return []


@dataclass
class Part:
    item: int | None
    words: list[bytes]
    answer: list[bytes]  # of the item, on its last part


def parts_of(item: int | None, text: str) -> list[Part]:
    """An item in one part, or, if it is longer than a passage, in parts of about equal length."""
    words = words_of(text.encode())
    if not words:
        return []
    n = -(-len(words) // PASSAGE)
    cuts = [len(words) * i // n for i in range(n + 1)]
    return [Part(item, words[a:b], answer_of(text) if b == len(words) else [])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def blocks_of(benchmark: DataFrame) -> Iterator[list[Part]]:
    block: list[Part] = []
    for r in benchmark.where("text is not null").select("item_id", "text").distinct().orderBy(
            "item_id", "text").toLocalIterator():
        block += parts_of(r["item_id"], r["text"])
        if len(block) >= BLOCK_PARTS:
            yield block
            block = []
    if block:
        yield block


@dataclass
class Index:
    """Vocabulary of a block, weights of its words and its latent space (words, rank)."""

    at: dict[bytes, int]
    weight: np.ndarray
    space: np.ndarray
    sets: dict[bool, tuple[pa.Array, np.ndarray]] = field(default_factory=dict, repr=False)

    def known(self, texts: list[bytes], heavy: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of texts that are in the vocabulary, with ``heavy`` those of some weight: (text, position in it, number
        of the word) of each, and how many words each text has."""
        if heavy not in self.sets:
            words = [w for w, i in self.at.items() if not heavy or self.weight[i] > 0]
            self.sets[heavy] = pa.array(words, pa.large_string()), np.array([self.at[w] for w in words], np.int64)
        of, numbers = self.sets[heavy]
        plain = [_plain(x).strip() for x in texts]
        split = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))  # only blanks are left between words
        ends = np.asarray(split.offsets)
        found = pc.index_in(split.values, value_set=of)
        where = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        text = np.searchsorted(ends, where, "right") - 1
        return text, where - ends[text], numbers[found.drop_null().to_numpy()], np.where([*map(len, plain)], np.diff(ends), 0)


def entries(passage: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (passage, word), each once, by passage."""
    key = np.sort(passage.astype(np.int64) * size + word)
    return np.divmod(key[np.append(True, key[1:] != key[:-1])[:len(key)]], size)


def sums(vectors: np.ndarray, index: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, sum of the rows ``vectors[index]`` of each key); ``keys`` are sorted.

    The first rows of all keys are added, then their second ones, and so on; keys of over ``MANY`` rows on their own."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    n = np.diff(np.append(starts, len(keys)))
    out = np.empty((len(starts), vectors.shape[1]), vectors.dtype)
    for k in np.flatnonzero(n > MANY).tolist():
        out[k] = vectors[index[starts[k]:starts[k] + n[k]]].sum(0)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] <= MANY]
    if len(order):
        first = starts[order]
        total = vectors[index[first]]
        for t, on in enumerate(np.searchsorted(-n[order], -np.arange(2, n[order[0]] + 1), "right").tolist(), 1):
            total[:on] += vectors[index[first[:on] + t]]
        out[order] = total
    return keys[starts], out


def ranges(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of all places in ranges."""
    n = ends - begins
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) + np.repeat(begins - np.cumsum(n) + n, n)


def spans(row: np.ndarray, step: int) -> list[tuple[int, int]]:
    """Cuts of sorted rows into spans of about ``step`` that part no row from its equals."""
    begins = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
    cuts = np.unique(begins[np.searchsorted(begins, np.arange(0, len(row), step), "right") - 1]).tolist()
    return list(zip(cuts, [*cuts[1:], len(row)], strict=True)) if cuts else []


def _passages(docs: DataFrame, index: Index, work, schema: str, heavy: bool) -> DataFrame:
    """Run ``work(state, passage, word, number of passages)`` over non-overlapping passages; it ends with None."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix, state = shared.value, {}
        for batch in batches:
            text, where, ids, words = ix.known(utf8(batch.column(0)), heavy)
            passages = -(-words // PASSAGE)
            if n := int(passages.sum()):
                row, word = entries((np.cumsum(passages) - passages)[text] + where // PASSAGE, ids, len(ix.at))
                work(ix, state, row, word, n)
        yield from work(ix, state, None, None, 0) or ()

    return docs.select("text").mapInArrow(run, schema)


def document_frequencies(docs: DataFrame, index: Index) -> tuple[np.ndarray, int]:
    """Number of passages with each word of the vocabulary, and of all passages."""
    def work(ix, state, row, word, n):
        if row is not None:
            state["df"] = state.get("df", 0) + np.bincount(word, minlength=len(ix.at))
            state["n"] = state.get("n", 0) + n
        elif state:
            some = np.flatnonzero(state["df"])
            return [pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()),
                                                pa.array(np.append(state["df"][some], state["n"]), pa.int64())], names=["word", "n"])]

    out, n = np.zeros(len(index.at), np.int64), 0
    for r in _passages(docs, index, work, "word bigint, n bigint", False).groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r["word"] < 0:
            n = r["n"]
        else:
            out[r["word"]] = r["n"]
    return out, n


def gram_product(docs: DataFrame, index: Index, own: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'(A x) over the passages of ``docs`` and the rows ``own`` (parts, words) of the items."""
    wide = docs.sparkSession.sparkContext.broadcast((x * index.weight[:, None]).astype(np.float32))  # (words of a block, rank)

    def work(ix, state, row, word, n):
        if row is not None:
            for a, b in spans(row, SPAN):
                r, w = row[a:b], word[a:b]
                at, total = sums(wide.value, w, r)
                order = np.argsort(w, kind="stable")
                at, total = sums(total, np.searchsorted(at, r)[order], w[order])
                state.setdefault("sum", np.zeros(wide.value.shape, np.float32))[at] += total * ix.weight[at, None]
        elif state:
            some = np.flatnonzero(state["sum"].any(1))
            flat = pa.array(state["sum"][some].ravel())
            return [pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.ListArray.from_arrays(
                pa.array(np.arange(len(some) + 1) * x.shape[1], pa.int32()), flat)], names=["word", "row"])]

    def add(batches):
        for t in runs(batches, ["word"]):
            rows = np.concatenate([c.flatten().to_numpy() for c in t.column("row").chunks]).reshape(t.num_rows, -1)
            yield pa.RecordBatch.from_arrays([t.column("word").chunk(0).slice(0, 1), pa.array([rows.sum(0, dtype=np.float64)])],
                                             names=["word", "row"])

    shares = _passages(docs, index, work, "word bigint, row array<float>", True)
    out = own.T @ (own @ x)
    for r in shares.repartition("word").sortWithinPartitions("word").mapInArrow(add, "word bigint, row array<double>").collect():
        out[r["word"]] += r["row"]
    return out


def build(docs: DataFrame, parts: list[Part]) -> Index:
    """Weights and latent space of a block over all passages of ``docs``."""
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p.words))}
    index = Index(vocabulary, np.ones(len(vocabulary), np.float32), np.zeros((0, 0), np.float32))
    df, n = document_frequencies(docs, index)
    index.weight = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.01)
    often = df > max(MAX_SHARE * n, 1)
    for p in parts:
        ids = sorted({vocabulary[w] for w in p.words}, key=lambda i: (df[i], i))
        often[ids[:RAREST]] = False
    index.weight[often] = 0
    own = np.zeros((len(parts), len(vocabulary)), np.float32)
    for i, p in enumerate(parts):
        for w in p.words:
            own[i, vocabulary[w]] = index.weight[vocabulary[w]]
    rank = min(RANK, len(vocabulary))
    rng = np.random.default_rng(SEED)
    q = np.linalg.qr(gram_product(docs, index, own, rng.normal(size=(len(vocabulary), rank))))[0]
    small = q.T @ gram_product(docs, index, own, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    index.space = (q @ vectors[:, np.argsort(-values)]).astype(np.float32)
    return index


def common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, with a bit for each word of ``a``."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def judge(part: Part, region: list[bytes]) -> tuple[float, float]:
    """Largest share of the part in order within 1.5 times its length of ``region``, and of its answer there."""
    n = len(part.words)
    best, answer = 0, 0.0
    if common(part.words, region) < min(FULL, PARTIAL) * n:
        return 0.0, 0.0
    width = n + max(2, n // 2)
    for a in range(0, max(1, len(region) - n // 2), max(1, n // 4)):
        piece = region[a:a + width]
        if (got := common(part.words, piece)) > best:
            best = got
            answer = common(part.answer, piece) / len(part.answer) if part.answer else 0.0
    return best / n, answer


def search(docs: DataFrame, parts: list[Part], index: Index, id_col: str, text_col: str) -> DataFrame:
    """(id, item_id, cosine, shared, answer) for each document row and item of the block found in it."""
    spark = docs.sparkSession
    z = np.zeros((len(parts), index.space.shape[1]), np.float32)
    for i, p in enumerate(parts):
        ids = np.unique([index.at[w] for w in p.words])
        z[i] = index.weight[ids] @ index.space[ids]
    size = np.linalg.norm(z, axis=1)
    # the heaviest word of a part is the rarest: a copy has it
    rarest = np.array([max((index.at[w] for w in p.words), key=lambda i: (index.weight[i], -i)) for p in parts])
    by_rarest = np.argsort(rarest, kind="stable")  # parts
    bounds = np.searchsorted(rarest[by_rarest], np.arange(len(index.at) + 1))  # of a word's parts in them
    length = np.array([len(p.words) for p in parts])
    inside = np.full((len(parts), length.max()), len(index.at))  # the words of parts; the number after the last one is none
    for i, p in enumerate(parts):
        inside[i, :length[i]] = [index.at[w] for w in p.words]
    wide = index.space * index.weight[:, None]
    shared = spark.sparkContext.broadcast((index, parts, z, np.where(size > 0, size, np.inf), wide, by_rarest, bounds, inside, length))
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("item_id", pa.int64()), ("cosine", pa.float64()), ("shared", pa.float64()), ("answer", pa.float64())]

    def covered(passage: np.ndarray, part: np.ndarray, begins: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """How many words of each candidate's part are among the words ``ids`` from its begin to its end, which are
        those beside its passage; ``passage`` is sorted."""
        none, inside = len(shared.value[0].at), shared.value[7]
        out = np.empty(len(part), np.int64)
        for a, b in spans(passage, max(1, min(CELLS // (none + 1), CELLS // 10 // inside.shape[1]))):
            new = np.append(True, passage[a + 1:b] != passage[a:b - 1])
            there = np.zeros((int(new.sum()), none + 1), bool)
            of, place = ranges(begins[a:b][new], ends[a:b][new])
            there[of, ids[place]] = True
            out[a:b] = there[np.cumsum(new)[:, None] - 1, inside[part[a:b]]].sum(1)
        return out

    def leaks(texts: list[bytes]) -> dict[tuple[int, int | None], tuple[float, float, float]]:
        """(number of the text, item) of the items found in texts."""
        ix, ps, items, sizes, wide, by_rarest, bounds, _, length = shared.value
        found: dict[tuple[int, int | None], tuple[float, float, float]] = {}
        text, where, ids, n = ix.known(texts)
        strides = -(-n // STRIDE)
        ends = np.cumsum(strides)  # a passage begins at every stride of the texts, numbered throughout
        begins = ends - strides
        stride = begins[text] + where // STRIDE
        some = ix.weight[ids] > 0
        # a word is in the passages that begin at its stride and the one before
        row, word = entries(np.concatenate([stride[some], np.maximum(stride[some] - 1, begins[text[some]])]),
                            np.concatenate([ids[some], ids[some]]), len(ix.at))
        words, opened = [], -1
        for a, b in spans(row, max(1, CELLS // (4 * items.shape[1] + 1))):
            at, v = sums(wide, word[a:b], row[a:b])
            has, place = ranges(bounds[word[a:b]], bounds[word[a:b] + 1])
            has, copied = np.searchsorted(at, row[a:b][has]), by_rarest[place]  # passages with the rarest word of parts
            for c in range(0, len(at), 4096):
                dots = v[c:c + 4096] @ items.T
                norm = np.linalg.norm(v[c:c + 4096], axis=1)
                k, i = np.nonzero(dots >= MIN_COVER * sizes * sizes)
                near = dots[k, i] / (norm[k] * sizes[i] + 1e-12) >= MIN_COSINE
                near = k[near] * len(ps) + i[near]
                x, y = np.searchsorted(has, [c, c + 4096])
                pair = np.union1d(near, (has[x:y] - c) * len(ps) + copied[x:y])
                k, i = np.divmod(pair, len(ps))
                passage = at[c + k]
                of = np.searchsorted(ends, passage, "right")
                got = covered(passage, i, np.searchsorted(stride, np.maximum(passage - 1, begins[of])),
                              np.searchsorted(stride, np.minimum(passage + PASSAGE // STRIDE, ends[of] - 1), "right"), ids)
                # words that are not there cannot be in a common subsequence
                on = got >= np.where(np.isin(pair, near), min(FULL, PARTIAL) * length[i], length[i])
                k, i, of = k[on], i[on], of[on]
                cosines = dots[k, i] / (norm[k] * sizes[i] + 1e-12)
                first = (passage[on] - begins[of]) * STRIDE
                for t, j, begin, cosine in zip(of.tolist(), i.tolist(), first.tolist(), cosines.tolist(), strict=True):
                    if opened != t:
                        words, opened = words_of(texts[t]), t
                    share, answer = judge(ps[j], words[max(0, begin - STRIDE):begin + PASSAGE + STRIDE])
                    if share >= FULL or share >= PARTIAL and answer >= ANSWER:
                        at_item = (t, ps[j].item)
                        found[at_item] = max(found.get(at_item, (0.0, 0.0, 0.0)), (share, cosine, answer))
        return found

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = sorted(leaks(utf8(batch.column(1))).items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1]))
        at = [t for (t, _), _ in found]
        cols = list(zip(*((item, cosine, share, answer) for (_, item), (share, cosine, answer) in found), strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(
            pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True))], names=[id_col, *(n for n, _ in fields)])

    return map_batches(docs.select(id_col, text_col), rows,
                       f"`{id_col}` {kind}, item_id bigint, cosine double, shared double, answer double")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, cosine, shared, answer): which items each row of ``docs`` contains."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found = None
    plain = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    for parts in blocks_of(benchmark):
        got = search(plain, parts, build(plain, parts), id_col, "text")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], f"`{id_col}` {kind}, item_id bigint, cosine double, shared double, answer double")
    return found.groupBy(id_col, "item_id").agg(F.max("cosine").alias("cosine"), F.max("shared").alias("shared"),
                                                F.max("answer").alias("answer"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that contain an item; columns as they were, whatever their names.

    Null and empty texts stay; of equal rows all stay or go; an empty table gives an empty one.
    """
    rows = wrapped(docs, row=row_key(F.col(id_col), F.col(text_col)), text=F.col(text_col))
    bad = contaminated(rows, benchmark, "row", "text").select("row").distinct()
    return rows.join(bad, "row", "left_anti").select("doc.*")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """The (document, item) pairs of all ``documents`` and all ``benchmark`` items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
