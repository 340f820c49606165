from collections import Counter, defaultdict
from math import log2

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillwork.llm import language
from rillwork.llm.common import crc_of
from tests.llm.odd import no_docs, odd_docs

SAMPLES = {"aa": [b"banana bandana", b"abab"], "bb": [b"tomato potato", b"toto \xc3\xa9"]}


def counted():
    rows = Counter()
    for lang, texts in SAMPLES.items():
        for text in texts:
            padded = bytes(language.ORDER) + text
            for i in range(len(text)):
                rows[lang, int.from_bytes(padded[i : i + language.ORDER + 1], "big")] += 1
    return pd.DataFrame([(a, b, n) for (a, b), n in rows.items()], columns=["lang", "gram", "n"])


def plain_bits(lang, text):
    seen = defaultdict(Counter)
    for own in SAMPLES[lang]:
        padded = bytes(language.ORDER) + own
        for i in range(language.ORDER, len(padded)):
            for k in range(language.ORDER + 1):
                seen[padded[i - k : i]][padded[i]] += 1
    total, padded = 0.0, bytes(language.ORDER) + text
    for i in range(language.ORDER, len(padded)):
        for k in range(language.ORDER, -1, -1):
            here = seen.get(padded[i - k : i])
            if here is None:
                continue
            size = sum(here.values()) + len(here)
            if padded[i] in here:
                total += log2(size / here[padded[i]])
                break
            total += log2(size / len(here))
        else:
            total += 8
    return total


@pytest.mark.parametrize("piece", [5, 1 << 19])
def test_code_lengths_are_those_of_the_trees(piece, monkeypatch):
    monkeypatch.setattr(language, "SLICE", piece)
    trees = language.ByteTrees.trained(counted())
    texts = [b"banana", b"tomato", b"", b"xyz", b"an to ba", b"potato bandana \xc3\xa9\xff", b"a" * 40]
    want = [[plain_bits(lang, t) for lang in sorted(SAMPLES)] for t in texts]
    assert np.allclose(trees.lengths(texts), want, rtol=1e-4, atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, F.pmod(crc_of("doc_id"), F.lit(4)) == 2).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98


def test_odd_rows(spark):
    held_out = F.pmod(crc_of("doc_id"), F.lit(4)) == 2
    docs = odd_docs(spark)
    rows = language.identify(docs, held_out).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 6)} == {"und"}
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert language.identify(no_docs(spark), held_out).count() == 0
    nothing = language.identify(docs.withColumn("lang", F.lit(None).cast("string")), held_out).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
