import numpy as np
import public_tokenizers
import tiktoken

import __spark_entry__
import corpus_pipeline
from railpulse.llm import byte_bpe, decontamination, secret_scan, toxicity
from railpulse.llm.common import table

from .conftest import DIRS
from .test_ngram_join import brute


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "secret_scan", "byte_bpe"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op") and k[2].isdigit()}


def test_run_equals_stage_by_stage_brute_force(spark, tmp_path):
    folder = DIRS["tiny"]
    docs = table(spark, folder, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    scorer = toxicity.Scorer(toxicity.train(docs, table(spark, folder, "labels")))
    kept = [(i, r.text) for i, r in sorted(rows.items()) if scorer.score(r.text.encode()) < 0.5]
    kept = [(i, rows[i].text) for i, c, _ in brute(kept) if i == c]
    items = [b" ".join(decontamination.words_of(r.text.encode())) for r in table(spark, folder, "benchmark").collect()]
    kept = [(i, t) for i, t in kept if not any(x in b" ".join(decontamination.words_of(t.encode())) for x in items)]
    codec = byte_bpe.codec(byte_bpe._rank_file(None), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})

    def redacted(t):
        out, done = "", 0
        for _, s, e in secret_scan.scan(t.encode()):
            if s >= done:
                out += t[done:s] + "[SECRET]"
            done = max(done, e)
        return out + t[done:]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(got) == [i for i, _ in kept] and 100 < len(got) < len(rows)
    for i, t in kept:
        assert got[i].ids == library.encode_ordinary(redacted(t)) and got[i].n_tokens == len(got[i].ids)
        assert codec.decode([np.array(got[i].ids, "<u4").tobytes()]) == [redacted(t).encode()]


def test_stages_keep_columns_and_edge_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", "en", None, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    folder = DIRS["tiny"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, folder)
        assert out.schema.simpleString() == df.schema.simpleString(), name
        assert out.count() == (2 if name == "ngram_join" else 4)
        assert stage(spark, df.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, df, folder).count() == 4


def test_stages_keep_columns_with_names_of_their_own(spark):
    more = ["_row", "row", "_n", "n", "id", "key", "shard", "bucket", "doc", "head", "rid"]
    df = spark.createDataFrame([(i, f"word{i % 3} one two three four five six {i % 3}") for i in range(6)], "doc_id bigint, text string")
    df = df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "0L as n_chars", *[f"concat('{c}', doc_id) as `{c}`" for c in more])
    want = {r.doc_id: r.asDict() for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, DIRS["tiny"])
        assert out.columns == df.columns, name
        got = {r.doc_id: r.asDict() for r in out.collect()}
        assert got == {i: want[i] for i in got} and sorted(got) == (sorted({0, 1, 2}) if name == "ngram_join" else sorted(want)), name
    assert corpus_pipeline.STAGES[-1][1](spark, df, DIRS["tiny"]).count() == 6
