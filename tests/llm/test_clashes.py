"""Inputs whose other columns have the names that results and intermediate columns have."""

import pytest
from pyspark.sql import functions as F

from rillwork.llm import chosen_path, language, secrets, toxicity

NAMES = ["found", "n_live", "n_copied", "n_assign", "n_access", "n_hex", "base_sha256", "row", "judged", "score", "predicted", "lang_pred", "set_", "row_", "digest",
         "class_id", "n_links", "kept", "node", "copies", "spans", "owner", "repository"]
TEXT = "the token = abcdef0123456789XYZ stands in a text with words enough to be a set of shingles"


@pytest.fixture
def docs(spark):
    rows = [(i, TEXT if i < 3 else f"other words number {i} that are like nothing else in here at all", "en", "a", 5) for i in range(5)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return base.select("*", *[F.lit("kept as it is").alias(n) for n in NAMES])


def untouched(df, but=()):
    assert all(getattr(r, n) == "kept as it is" for r in df.collect() for n in NAMES if n not in but)


def test_mask_live(docs):
    got = secrets.mask_live(docs)
    assert got.columns == docs.columns and got.count() == 5
    untouched(got)
    assert all("[SECRET]" in r.text and r.n_chars == len(r.text) for r in got.collect() if r.doc_id < 3)


def test_one_of_each_group(docs):
    got = chosen_path.one_of_each_group(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 3, 4]
    untouched(got)


def test_predict(docs):
    got = language.predict(docs, language.train(docs, F.lit(True)))
    assert {r.lang_pred for r in got.collect()} == {"en"}
    untouched(got, ("lang_pred", "score"))


def test_score_texts(docs):
    model = toxicity.Model(toxicity.letter_costs(toxicity.language_counts(docs.select("text")), []), {}, [-1.0, 0.0, 0.0, 0.0, 0.0])
    got = toxicity.score_texts(docs, model)
    assert {r.predicted for r in got.collect()} == {0}
    untouched(got, ("score", "predicted"))
