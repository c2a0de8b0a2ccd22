import zlib

import numpy as np
import pytest

from railpulse.llm import toxicity as x

from .conftest import DIRS


def test_held_out_accuracy(spark):
    got = x.op8_toxicity(spark, "/root/testdata/sf0.1")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    clean, toxic = [r for r in held if r.toxic == 0], [r for r in held if r.toxic == 1]
    assert np.mean([r.predicted for r in clean]) < 0.01
    assert np.mean([r.predicted for r in toxic]) > 0.6  # 315 labelled toxic texts, three languages with about 60 each


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet(f"{DIRS['small']}/documents.parquet")
    labels = spark.read.parquet(f"{DIRS['small']}/labels.parquet")
    texts, marks = x.sample(docs, labels)
    flipped = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, 1 - toxic, toxic) as toxic")
    assert (texts, marks) == x.sample(docs, flipped) and len(texts) == len(marks) > 100


def toy():
    base = [f"word{i % 17} thing{i % 5} more{i % 3} text{i % 29}" for i in range(400)]
    return [(b + (" vilenes" + "sab"[i % 3] if i % 4 == 0 else "")).encode() for i, b in enumerate(base)], [int(i % 4 == 0) for i in range(400)]


def test_learns_words_and_prefixes():
    texts, labels = toy()
    m = x.fit(texts, labels)
    s = x.Scorer(m)
    assert all((s.score(t) >= 0.5) == bool(y) for t, y in zip(texts, labels, strict=True))
    assert s.score(b"word3 thing2 VILENESS! more1") >= 0.5 > s.score(b"word3 thing2 more1")
    again = x.fit(texts, labels)
    assert (again.embed == m.embed).all() and again.thresholds == m.thresholds


def test_slices_do_not_change_a_score(monkeypatch):
    m = x.fit(*toy())
    text = b"word3 thing2 " * 40 + b"vileness" + b" more1 text4" * 30
    want = x.Scorer(m).score(text)
    monkeypatch.setattr(x, "SLICE", 7)
    monkeypatch.setattr(x, "CACHE_WORDS", 2)
    s = x.Scorer(m)
    assert [s.score(text), s.score(text)] == pytest.approx([want, want], abs=1e-6)


def test_edges(spark, docs):
    m = x.fit(*toy())
    rows = [(1, None), (2, ""), (None, "vileness word1"), (4, "word1"), (4, "word1"), (5, "word1 " * 100_000)]
    df = docs(rows)
    got = sorted((r.doc_id or 0, r.score) for r in x.scores(df, m).collect())
    assert [g[0] for g in got] == [0, 1, 2, 4, 4, 5] and got[1][1] == got[2][1] and got[3] == got[4] and got[0][1] >= 0.5
    kept = x.keep_clean(df, m)
    assert kept.schema == df.schema and sorted(r.doc_id or 0 for r in kept.collect()) == [1, 2, 4, 4, 5]
    labels = spark.createDataFrame([(1, None), (4, 0), (None, 1)], "doc_id bigint, toxic int")
    none = x.train(df, labels)
    assert none is None and {(r.score, r.predicted) for r in x.scores(df, none).collect()} == {(0.0, 0)}
    assert x.scores(docs([]), m).count() == 0
    assert x.threshold(np.array([-3.0, -2.0, 1.0, 2.0]), np.array([0, 0, 1, 1])) == -0.5


def test_all_labelled_rows_are_learned_from(spark, docs, monkeypatch):
    texts, marks = toy()
    far = b"calm " * 3000 + b"zzfar"  # its only sign of toxicity lies behind many characters
    rows = [(i, t.decode()) for i, t in enumerate(texts)] + [(1000 + i, (far if i % 2 else b"calm " * 3000).decode()) for i in range(60)]
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(marks)] + [(1000 + i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    for shard in (5000, 100):  # one shard, several
        monkeypatch.setattr(x, "SHARD", shard)
        m = x.train(docs(rows), labels)
        s = x.Scorer(m)
        assert np.mean([(s.score(t.encode()) >= 0.5) == bool(y) for (_, t), y in zip(rows, marks + [i % 2 for i in range(60)], strict=True)]) > 0.95
        assert s.score(far) > s.score(b"calm " * 3000)


def test_rows_of_a_word_are_made_once(monkeypatch):
    made = []
    kept = x.Kept(lambda ws: made.extend(ws) or x.rows_of(ws), 3, np.int64, -1)
    texts = [[b"a", b"b", b"a"], [], [b"b", b"c", b"c"]]
    for words in texts:
        assert (x.sequence(words, kept) == np.concatenate([x.rows_of(words), np.full((2 + (not words), 3), -1)])).all()
    assert made == [b"a", b"b", b"c"]
    monkeypatch.setattr(x, "CACHE_WORDS", 2)
    assert (kept.rows([b"d", b"a"], 0) == x.rows_of([b"d", b"a"])).all() and len(kept.seen) == 2


def test_training_texts_are_dealt_once(spark, docs, monkeypatch):
    texts, marks = toy()
    monkeypatch.setattr(x, "SHARD", 100)
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id bigint, toxic int")
    texts = docs([(i, t.decode()) for i, t in enumerate(texts)])
    for threshold in ("10MB", "-1"):
        own = {"spark.sql.autoBroadcastJoinThreshold": threshold, "spark.sql.shuffle.partitions": "64"}
        before = {k: spark.conf.get(k) for k in own}
        for k, v in own.items():
            spark.conf.set(k, v)
        try:
            rows = x.training_rows(texts, labels)
            above = rows._jdf.queryExecution().executedPlan().toString().split("Join")[0]
            assert "Exchange" not in above and rows.rdd.getNumPartitions() == 4
            assert sorted(r["_id"] for r in rows.collect()) == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)


def test_the_model_reaches_the_driver_in_columns(spark, docs, monkeypatch):
    texts, marks = toy()
    df, many = docs([(i, t.decode()) for i, t in enumerate(texts)]), []
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id bigint, toxic int")
    plain = type(df).collect

    def collect(self):
        many.append(self.columns)
        return plain(self)

    monkeypatch.setattr(type(df), "collect", collect)
    for shard in (5000, 100):
        monkeypatch.setattr(x, "SHARD", shard)
        m = x.train(df, labels)
        assert x.Scorer(m).score(b"word3 vileness") >= 0.5
    assert many and not any("row" in columns for columns in many)  # else there is an object for each number of the model
