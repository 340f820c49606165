"""Numbers beyond 2**53 beside nulls come back unrounded from every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillwork.llm import hilbert
from rillwork.llm.queries import QUERIES

BIG = [2**60 + 1, None, 2**60 + 3]
PROSE = "the plain words of number {} stand here in a row so that a text is long enough to be judged by its language and kept"


def numbers(df, column):
    return sorted((getattr(r, column) for r in df.select(column).distinct().collect()), key=str)


@pytest.fixture
def tables(spark, folder):
    docs = [(i, PROSE.format(k), "en", "a", 100) for k, i in enumerate(BIG)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in BIG], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("key", [k for k in QUERIES if k.split("_")[0] in ("op1", "op2", "op3", "op6", "op7", "op9", "op10", "op11", "op13")])
def test_queries_over_documents(spark, tables, key):
    assert numbers(QUERIES[key](spark, tables), "doc_id") == sorted(BIG, key=str)


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:]:  # three documents are too few to learn a language from
        docs = stage(spark, docs, tables)
        assert numbers(docs, "doc_id") == sorted(BIG, key=str)


def test_queries_of_vectors(spark):
    ids = [2**60 + 1, 2**60 + 5, 2**60 + 9]
    rows = [(v, [1.0, 0.1 * k]) for k, v in enumerate(ids)]
    got = hilbert.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(a, b) for a in ids for b in ids if a != b]


