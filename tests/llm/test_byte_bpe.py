import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from railpulse.llm import byte_bpe as b

from .conftest import DIRS


@pytest.fixture(scope="module")
def codec():
    return b.codec(b._rank_file(None), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def texts():
    rng = random.Random(2)
    yield from ["", "a", "   ", "\n\n x", "a" * 24, "=" * 1000, "ab" * 1500, "it's we'll 123 !!!  \t", "<|endoftext|>", "\0 \x1f"]
    yield "".join(rng.choice("etaoinsrhl") for _ in range(600))
    for _ in range(300):
        yield "".join(rng.choice("aab bcdeéß 漢🙂\n\t.!1") for _ in range(rng.randint(0, 60)))


def test_equals_the_library(codec, library):
    data = [t.encode() for t in texts()]
    ids = codec.encode(data)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t.decode()) for t in data]
    assert codec.decode(ids) == data


def test_small_bounds_change_nothing(codec, monkeypatch):
    data = [t.encode() for t in texts()]
    want = codec.encode(data)
    for name, value in (("CALL_BYTES", 50), ("CALL_ROWS", 400), ("DECODE_TOKENS", 7), ("GROUP_STRETCHES", 20), ("CACHE_PIECES", 5)):
        monkeypatch.setattr(b, name, value)
    codec.pieces.clear()
    codec.stretches.clear()
    assert codec.encode(data[:120]) == want[:120] and codec.decode(want[:40]) == data[:40]


def test_long_pieces(codec, library):
    rng = random.Random(9)
    some = ["ab" * 500_000, "a" * 100_001, "=" * 300_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)),
            "".join(rng.choice(["the", "ing", "tion", "er", "on"]) for _ in range(20_000)), "漢字" * 3000, "ab" * 128 + "c", "x" * 257]
    some += ["".join(rng.choice("ab") for _ in range(rng.randrange(250, 2000))) for _ in range(10)]
    for text in some:
        assert np.frombuffer(codec.encode([text.encode()])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_query_equals_the_library(spark, documents, library):
    got = {r.doc_id: r for r in b.op7_byte_bpe(spark, DIRS["small"]).collect()}
    assert len(got) == len(documents)
    for i, t in documents:
        ids = library.encode_ordinary(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_edges_and_round_trip(docs):
    rows = [(1, None), (2, ""), (3, "x y"), (3, "x y"), (None, "é🙂")]
    made = b.encode(docs(rows))
    assert sorted((r.doc_id or 0, r.n_tokens == len(r.ids)) for r in made.collect()) == [(0, True), (1, True), (2, True), (3, True), (3, True)]
    assert sorted((r.doc_id or 0, r.text) for r in b.decode(made).collect()) == [(0, "é🙂"), (1, ""), (2, ""), (3, "x y"), (3, "x y")]
    assert b.encode(docs([])).count() == 0
