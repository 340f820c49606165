"""The registered queries over whole tables: columns, one row per document, vector, page or piece, and SQL where there is."""

import pytest

import __spark_entry__ as contract
from rillwork.llm.queries import ORACLES, QUERIES
from tools.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
#: Columns of the contract, and the table whose rows the result has.
COLUMNS = {
    "op1": ("documents", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]),
    "op2": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op3": ("documents", ["doc_id", "held_out", "lang_pred", "score"]),
    "op4": ("pages", ["page_id", "host", "path", "rule", "verdict"]),
    "op5": (None, ["query_id", "rank", "vec_id", "score"]),
    "op6": (None, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]),
    "op7": ("documents", ["doc_id", "class_id", "n_links"]),
    "op8": ("embeddings", ["vec_id", "n_links", "component_id", "kept"]),
    "op9": ("documents", ["doc_id", "start", "n_tokens", "ids_crc32"]),
    "op10": ("documents", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    "op11": ("documents", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    "op12": (None, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]),
    "op13": ("documents", ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]),
}


@pytest.mark.parametrize("key", list(QUERIES))
def test_columns_and_rows(spark, key):
    table, columns = COLUMNS[key.partition("_")[0]]
    got = contract.queries()[key](spark, SF_DIR)
    assert set(columns) <= set(got.columns)
    if table:
        assert got.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    else:
        assert got.count() > 0


@pytest.mark.parametrize("key", list(ORACLES))
def test_same_as_sql(spark, key):
    verdict, _ = compare(spark, connect(SF_DIR), key, SF_DIR, QUERIES, ORACLES)
    assert verdict.startswith("ok"), verdict
