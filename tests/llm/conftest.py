import pytest

DIRS = {"tiny": "/root/testdata/sf0.001", "small": "/root/testdata/sf0.01"}


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) of the small documents table, on the driver."""
    return [tuple(r) for r in spark.read.parquet(f"{DIRS['small']}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture
def docs(spark):
    """Make a documents frame of (doc_id, text) pairs with columns whose names operators use themselves."""
    def make(rows, parts=3):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        return df.selectExpr("doc_id", "text", "'x' as spans", "1 as score", "2L as n", "'k' as key", "0 as shard", "'c' as class_id")
    return make
