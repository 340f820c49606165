import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rillwork.llm import bpe
from tests.llm.odd import ODD, no_docs, odd_docs

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_of_any_length(reference):
    own, rng = bpe.coder(PATH, PATTERN), random.Random(1)
    texts = ["a" * 5000, "ab" * 700, "".join(rng.choice("abcdeé") for _ in range(3000)), "日本" * 90, "!?" * 70, " " * 300 + "x", "x"]
    texts += ["".join(rng.choice("etaoinsh") for _ in range(n)) for n in range(1, 140)]
    ids, counts = own.encode(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert [own.decode(np.array(x)) for x in got] == [t.encode() for t in texts]


def test_random_texts(reference):
    own = bpe.coder(PATH, PATTERN)

    @settings(max_examples=200, deadline=None)
    @given(st.text(max_size=200))
    def check(text):
        ids, _ = own.encode([text])
        assert ids.tolist() == reference.encode_ordinary(text)

    check()


def test_round_trip_of_odd_rows(spark, reference):
    got = sorted(map(tuple, bpe.round_trip(odd_docs(spark), PATH, PATTERN).collect()), key=str)
    want = []
    for doc_id, text, *_ in ODD:
        ids = reference.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    decoded = bpe.decode_ids(bpe.encode_texts(odd_docs(spark), PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in decoded) == sorted((t or "").encode() for _, t, *_ in ODD)
    assert bpe.round_trip(no_docs(spark), PATH, PATTERN).count() == 0


def test_wide_rows_give_the_ids_of_single_merges(monkeypatch):
    ranked = bpe.RankedBytes(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(3)
    pieces = [bytes(rng.choice(list(letters), n).astype(np.uint8)) for letters in (b"ab", b"aeinrst", bytes(range(97, 123))) for n in (65, 100, 200) for _ in range(20)]
    wide = [x.tolist() for x in ranked.pieces(pieces)]
    monkeypatch.setattr(bpe, "SHORT", 1 << 30)
    assert wide == [x.tolist() for x in ranked.pieces(pieces)]
