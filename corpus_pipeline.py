"""Corpus pipeline: toxicity filter, near-duplicate removal, benchmark decontamination, secret redaction,
byte-level BPE.

Every stage works on all rows its predecessor kept; all but the last return the columns of ``documents``
as they came (the redaction changes text and n_chars of rows with secrets).  The last returns token ids.
Each stage's result is written as Parquet in the shared folder and read again for the next one.

Null texts read as empty; empty and null texts pass every filter but the second, where they are one class.
Ties and repeated rows: of rows with equal id and text, and of each class, the second stage keeps one; the other
stages treat equal rows alike.  Empty tables give empty ones.  Long texts are read whole, a batch at a time.  Further
columns pass unread, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from railpulse.llm import byte_bpe, decontamination, ngram_join, secret_scan, toxicity
from railpulse.llm.common import table
from railpulse.session import checkpoint_root


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's labelled rows, does not call toxic."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join: that with the smallest id."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; null texts stay null."""
    return secret_scan.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of all documents; null and empty texts have no ids."""
    return byte_bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("byte_bpe", tokenize),
]

#: A trained classifier, MinHash and BPE cannot be expressed in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    root = f"{checkpoint_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.parquet(f"{root}/{i}-{name}")
    return docs
