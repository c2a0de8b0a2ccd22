import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from railpulse.llm import long_pieces, packing as p, word_bpe

from .conftest import DIRS


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(word_bpe.file_content())


def expected(library, rows):
    """(doc_id, piece, start, length, crc32) of every piece, straight from the library."""
    out = []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            out.append((i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def check_places(got, capacity=4096):
    """Sequences hold at most ``capacity`` tokens, without gaps or overlaps."""
    rows = defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for own in rows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(rows)


def test_query_is_whole_and_tight(spark, documents, library):
    got = p.op12_packing(spark, DIRS["small"]).collect()
    want = expected(library, documents)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert check_places(got) == -(-sum(x[3] for x in want) // 4096)  # no packing has fewer


def test_codec_equals_the_library(library):
    codec = word_bpe.WordCodec(word_bpe.file_content())
    rng = random.Random(1)
    texts = ["", " ", "It's 12 o'clock, they'll say", "a <|endoftext|> b", "é éa", "日本語 text", "İſŉ Σας ΑΣ", "\x00\x1c\x85\xa0x", "a​b"]
    texts += ["".join(chr(rng.randrange(word_bpe.PLAIN_END)) if rng.random() < 0.5 else rng.choice("abc's 'll 12 ")
                      for _ in range(rng.randrange(80))) for _ in range(500)]
    texts += [x for c in map(chr, range(word_bpe.PLAIN_END)) for x in (c, f"a{c}b", f"{c}{c} {c}", f"1{c}")]
    for text in texts:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_parts_and_generations(library, monkeypatch):
    monkeypatch.setattr(word_bpe, "PART_CHARS", 50)
    monkeypatch.setattr(word_bpe, "RECENT", 7)
    codec = word_bpe.WordCodec(word_bpe.file_content())
    rng = random.Random(5)
    for sort in ("abcdé '1.,\n  ", "abé日 \t"):
        text = "".join(rng.choice(sort) for _ in range(5000))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_in_segments(library):
    codec = word_bpe.WordCodec(word_bpe.file_content())
    rng = random.Random(2)

    def part(data, last):
        got = (codec.model if last else codec.inner()).tokenize(data.decode())
        return np.array([t.id for t in got], "<u4"), np.array([t.offsets[1] - t.offsets[0] for t in got])

    for _ in range(200):
        n = rng.randrange(300, 2000)
        word = rng.choice([
            "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), rng.choice(["ab", "aaa", "the", "xyxz"]) * (n // 3),
            "".join(rng.choice(["the", "ing", "tion", "er", "on", "a", "st", "ed"]) for _ in range(n // 3)), "".join(rng.choice("ab") for _ in range(n))])
        got = long_pieces.encode_long(word.encode(), part, rng.choice([40, 64, 100]), rng.choice([8, 16, 30]))
        assert got.tolist() == library.encode(word, add_special_tokens=False).ids


def test_a_word_of_eight_million_letters():
    codec = word_bpe.WordCodec(word_bpe.file_content())
    ids = np.frombuffer(codec.encode("ab" * 4_000_000), "<u4")
    assert len(ids) == 4_000_000 and len(set(ids[:-1].tolist())) == 1


def random_counts(rng, capacity):
    low, high = rng.choice([(1, capacity), (capacity // 4, capacity // 2 + 1), (capacity // 5, capacity // 2)])
    return Counter({rng.randrange(max(1, low), high + 1): rng.choice([1, 1, 3, 40]) for _ in range(rng.randrange(1, 40))})


def contents(bins):
    total = Counter()
    for content, times in bins.items():
        assert times > 0
        for length, n in content:
            total[length] += n * times
    return total


def test_best_fit_equals_a_plain_one():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([10, 30, 100])
        counts = random_counts(rng, capacity)
        rooms = []
        for x in sorted(counts.elements(), reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= x]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= x
            else:
                rooms.append(capacity - x)
        bins = p.best_fit(counts, capacity)
        assert contents(bins) == counts and all(p.fill_of(b) <= capacity for b in bins)
        assert sum(bins.values()) == len(rooms)


def test_search_never_loses_and_often_wins():
    rng = random.Random(4)
    better = 0
    for _ in range(60):
        capacity = rng.choice([30, 100])
        counts = random_counts(rng, capacity)
        bins = p.best_fit(counts, capacity)
        found = p.search(bins, capacity)
        assert contents(found) == counts and all(p.fill_of(b) <= capacity for b in found)
        assert sum(found.values()) <= sum(bins.values())
        better += sum(found.values()) < sum(bins.values())
    assert better >= 5


def test_search_mends_a_known_bad_start():
    # best fit needs three bins of ten, an exchange of one for two makes it two
    start = {((6, 1),): 1, ((5, 1), (2, 1)): 1, ((4, 1), (3, 1)): 1}
    assert sum(p.search(start, 10).values()) == 2
    # and as many times as there are such bins
    assert sum(p.search({b: 5000 for b in start}, 10).values()) == 10_000


def test_changes_are_those_allowed_and_add_squared_fill():
    rng = random.Random(6)
    for _ in range(300):
        a, b = (tuple(sorted(Counter(rng.randrange(1, 20) for _ in range(rng.randrange(1, 4))).items(), reverse=True)) for _ in range(2))
        gap, least = 60 - p.fill_of(b), max(0, p.fill_of(a) - p.fill_of(b))
        pieces = [list(Counter(dict(x)).elements()) for x in (a, b)]
        some = [[c for n in (0, 1, 2) for c in itertools.combinations(x, n)] for x in pieces]
        gains = [sum(x) - sum(y) for x in some[0] for y in some[1]
                 if (len(x), len(y)) in {(1, 0), (1, 1), (2, 1), (1, 2)} and least < sum(x) - sum(y) <= gap]
        found = p.best_change(a, b, gap, least)
        assert (found is None) == (not gains)
        if found:
            assert sum(found.give) - sum(found.back) == max(gains)
            new = p.fill_of(p.changed(a, found.give, found.back)), p.fill_of(p.changed(b, found.back, found.give))
            assert sum(x * x for x in new) > p.fill_of(a) ** 2 + p.fill_of(b) ** 2


def test_pack_any_rows(spark, monkeypatch):
    monkeypatch.setattr(p, "RANK_ROWS", 100)
    rng = random.Random(7)
    lengths = [rng.randrange(1, 51) for _ in range(3000)] + [10] * 2000
    df = spark.createDataFrame([(1, n, "same", n) for n in lengths], "row long, length int, part string, rank int").repartition(5)
    got = p.pack(df, capacity=50)
    assert got.columns == ["row", "length", "part", "rank", "sequence_id", "offset"]
    rows = got.collect()
    assert Counter(r.length for r in rows) == Counter(lengths)
    assert check_places(rows, 50) <= 1.02 * sum(lengths) / 50
    with pytest.raises(ValueError):
        p.pack(spark.createDataFrame([(51,)], "length int"), capacity=50)


def test_edges(docs, library):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same"), (4, "word " * 10_000), (4, "other"), (5, "x " * 4095), (6, "x " * 4096),
            (7, "é́ 日本")] + [(9, "equal rows")] * 300
    got = p.cut_documents(docs(rows))
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got.collect())
    packed = p.pack(got.drop("ids")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted([tuple(r)[:5] for r in packed], key=key) == sorted(expected(library, rows), key=key)
    check_places(packed)
    empty = p.pack(p.cut_documents(docs([]), ids=False))
    assert empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and empty.count() == 0
