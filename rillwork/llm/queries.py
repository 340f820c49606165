"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from rillwork.llm import blocks, bpe, chosen_path, compression, covertree, hilbert, hosts, language, merkle, negatives, packing, secrets, sql, toxicity
from rillwork.llm.common import crc_of
from rillwork.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

#: Fixed values of the contract: (verdict, rule).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op4_host_reputation", sql.HOST_REPUTATION)
def host_reputation(spark, sf_dir):
    """A page's outcome is the label that carries its number: bad if it is marked toxic or of low quality.
    Hosts without labelled pages are judged by what their domain, suffix or the overall rate says."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return hosts.judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES, unlabelled=True)


@query("op9_token_blocks")
def token_blocks(spark, sf_dir):
    return blocks.written_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), special=True)


@query("op10_padded_bpe")
def padded_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op6_harmonic_packing")
def harmonic_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), special=True)


@query("op1_secret_ownership")
def secret_ownership(spark, sf_dir):
    """A document's source stands for its owner, and the source's documents in one language for a repository."""
    docs = table(spark, sf_dir, "documents").withColumn("repository", F.concat_ws("/", "source", "lang"))
    found = secrets.weigh_secrets(docs, repository="repository", keep=("doc_id",))
    return found.withColumn("spans", secrets.span_text(F.col("found"))).drop("found")


@query("op3_byte_trees")
def byte_trees(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"), F.pmod(crc_of("doc_id"), F.lit(4)) == 2)


@query("op2_restored_toxicity")
def restored_toxicity(spark, sf_dir):
    held_out = F.pmod(crc_of("doc_id"), F.lit(5)) == 0
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


@query("op8_cover_tree_links")
def cover_tree_links(spark, sf_dir):
    return covertree.link_vectors(table(spark, sf_dir, "embeddings"), 0.98)


@query("op5_hilbert_windows")
def hilbert_windows(spark, sf_dir):
    return hilbert.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op7_chosen_path_join")
def chosen_path_join(spark, sf_dir):
    return chosen_path.jaccard_groups(table(spark, sf_dir, "documents")).drop("digest")


@query("op11_compression_bands")
def compression_bands(spark, sf_dir):
    return compression.judge_texts(table(spark, sf_dir, "documents"))


@query("op13_recomputed_proofs", sql.MERKLE_PROOFS)
def recomputed_proofs(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"))


@query("op12_rotated_codes")
def rotated_codes(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))
