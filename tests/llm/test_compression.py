import base64
import random
import re
from collections import Counter

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from rillwork.llm import compression
from rillwork.llm.queries import QUERIES
from tests.llm.odd import LONG, no_docs, odd_docs

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """The counts of the contract, character by character."""
    text = text or ""
    words = WORD.findall(text)
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\r\x0b\x0c\x1c\x85\xa0é日😀#|", max_size=60))
def test_counts_by_brute_force(text):
    assert compression.plain_counts(text.encode()) == brute(text)


def test_overlapping_windows():
    assert compression.repeated_words(b"a a a a".split()) == 4
    assert compression.repeated_words(b"a b c x a b c y".split()) == 6
    assert compression.repeated_words(b"a b".split()) == 0


def test_chunks_are_the_text():
    for n in (1, 9, 10, 11, 19, 20, 35):
        parts = [bytes(p) for p in compression.chunks_of(bytes(range(n)), 10)]
        assert b"".join(parts) == bytes(range(n)) and len(parts) == max(1, n // 10)


def brute_kept(text):
    data, packer = (text or "").encode(), zstandard.ZstdCompressor(level=3)
    n_words, _, _, _, n_repeat = brute(text)
    if n_words < 50 or 100 * n_repeat > 50 * n_words:
        return True, False

    def inside(part):
        low, high = compression.limits(len(part))
        return low <= len(packer.compress(part)) / len(part) <= high

    n = max(1, len(data) // 4096)
    parts = [data[i * 4096 : (i + 1) * 4096 if i < n - 1 else None] for i in range(n)]
    return False, inside(data) and sum(not inside(p) for p in parts) <= 0.34 * n


def test_query_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = QUERIES["op11_compression_bands"](spark, SF_DIR).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(docs[r.doc_id])
        assert (r.base_failed, r.kept) == brute_kept(docs[r.doc_id])


def test_good_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    judged = QUERIES["op11_compression_bands"](spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    good = judged.filter("quality = 1 and not base_failed")
    assert good.count() > 200 and good.filter("kept").count() == good.count()


def test_repetitive_and_incompressible_texts_go(spark):
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(4000))
    noise = " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(400))
    line = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(5)) for _ in range(60))
    counted = "\n".join(f"{line} {i}" for i in range(40))
    docs = spark.createDataFrame([(1, prose), (2, noise), (3, counted), (4, prose[:14000] + noise[:14000])], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in compression.judge_texts(docs).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_odd_rows(spark):
    clashing = odd_docs(spark).selectExpr("*", "doc_id AS ratio", "'x' AS kept", "1 AS n_words")
    got = compression.judge_texts(clashing, keep=("doc_id", "source", "ratio", "kept", "n_words")).collect()
    assert len(got) == odd_docs(spark).count()
    assert all(isinstance(r.kept, bool) and r.ratio == (r.ratio if r.n_bytes else None) for r in got)
    long = next(r for r in got if r.n_bytes == len(LONG))
    assert (long.n_words, long.n_repeat_words, long.base_failed, long.kept) == (30_000, 30_000, True, False)
    assert [r for r in got if not r.n_bytes] and all(r.base_failed for r in got if not r.n_bytes)
    assert compression.judge_texts(no_docs(spark)).count() == 0


def test_large_numbers_beside_nulls(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    docs = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id or 0 for r in compression.judge_texts(docs).collect()) == [0, 2**60 + 1, 2**60 + 3]
