"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. language: documents go whose language cannot be told (no text, no letter, or no language clearly likelier than all
   others together);
2. toxicity: documents go that the classifier predicts to be toxic;
3. near duplicates: of each group that Jaccard links join, the document with the smallest doc_id stays;
4. secrets: values that look like live credentials of few owners are masked in the text;
5. packing: the texts become sequences of 2048 tokens; the result is a row per piece.

All stages but the last return the columns of ``documents``. Models are trained from the stage's own input and, for
toxicity, the labels beside it.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm import chosen_path, language, packing, secrets, toxicity
from rillwork.llm.common import bounded_batches, crc_of
from rillwork.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents with a clearer language than this stay.
LEAST_LANGUAGE_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    own = docs.select(COLUMNS)
    trees = language.train(own, F.pmod(crc_of("doc_id"), F.lit(4)) != 2)
    judged = language.predict(own, trees)
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    own = docs.select(COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(own.select("doc_id", "text"), labels, F.pmod(crc_of("doc_id"), F.lit(5)) != 0)
    return toxicity.score_texts(own, model).filter("predicted = 0").select(COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return chosen_path.one_of_each_group(docs.select(COLUMNS)).select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    own = docs.select(*COLUMNS, F.concat_ws("/", "source", "lang").alias("repository"))
    return secrets.mask_live(own, repository="repository").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), special=True)


STAGES = [
    ("language", keep_languages),
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL cannot express the stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, partial(stage, spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
