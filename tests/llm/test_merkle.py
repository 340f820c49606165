import hashlib
from zlib import crc32

import pytest

from rillwork.llm import merkle
from rillwork.llm.queries import QUERIES
from tests.llm.odd import LONG, no_docs, odd_docs

SF_DIR = "/root/testdata/sf0.001"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """All levels over the nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path_of(levels, at):
    steps = []
    for level in levels[:-1]:
        begin = at // 16 * 16
        steps.append((level[begin:at], level[at + 1 : begin + 16]))
        at //= 16
    return steps


def brute(rows):
    """Rows of the contract, by whole trees in memory."""
    sources = sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(((r.doc_id is not None, r.doc_id or 0), leaf_of(r, r.text), i) for i, r in enumerate(rows) if r.source == s) for s in sources}
    trees = {s: climb([x[1] for x in leaves[s]]) for s in sources}
    top = climb([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, leaf, i) in enumerate(leaves[s]):
            steps, row, text = path_of(trees[s], at) + path_of(top, k), rows[i], rows[i].text
            if row.doc_id is not None and crc32(str(row.doc_id).encode()) % 5 == 0 and text:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(row, text)
            for left, right in steps:
                node = digest(*left, node, *right)
            proof = digest(*[x for left, right in steps for x in (*left, *right)])
            out.append((row.doc_id, leaf, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


def test_query_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    found = got(QUERIES["op13_recomputed_proofs"](spark, SF_DIR))
    assert found == brute(rows)
    assert 0 < sum(not r[-1] for r in found) < len(found)


@pytest.mark.parametrize("keep_every", [1, 2, 3])
def test_several_stored_levels_and_a_large_group(spark, keep_every):
    """One group of 4,500 leaves (four levels), small ones, lone ones, runs of one."""
    rows = [(i, "hot" if i < 4500 else f"s{i % 40}" if i < 4700 else f"lone{i}", None, i, f"Text {i}") for i in range(4740)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert got(merkle.audit(docs, keep_every)) == brute(docs.collect())


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257])
def test_sizes_about_full_runs(spark, n):
    docs = spark.createDataFrame([(i, "s", "l", 1, "A") for i in range(n)], "doc_id long, source string, lang string, n_chars long, text string")
    assert got(merkle.audit(docs)) == brute(docs.collect())


def test_only_stored_levels_are_written(spark):
    leaves = spark.range(1000).selectExpr("'a' AS tree", "id", "sha2(CAST(id AS STRING), 256) AS hash")
    manifest = merkle.build_manifest(leaves, "id")
    assert [manifest.groups.level(spark, i).count() for i in range(len(manifest.groups.levels))] == [4, 1]
    assert manifest.groups.level(spark, 0).selectExpr("max(size(nodes))").first()[0] == 256


def test_odd_rows(spark):
    docs = odd_docs(spark).selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars", "'x' AS tree", "'y' AS pos", "'z' AS hash", "1 AS leaf")
    assert len(LONG) > 100_000
    assert got(merkle.audit(docs)) == brute(docs.select("doc_id", "text", "lang", "source", "n_chars").collect())
    assert merkle.audit(no_docs(spark).selectExpr("*", "1L AS n_chars")).count() == 0


def test_large_numbers_beside_nulls(spark):
    docs = spark.createDataFrame([(i, "s", "l", 1, "A") for i in (2**60 + 1, None, 2**60 + 3)], "doc_id long, source string, lang string, n_chars long, text string")
    assert got(merkle.audit(docs)) == brute(docs.collect())
