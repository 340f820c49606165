import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rillwork.llm import tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = ["a  b   c\n\n d \n e", " x", "", "trail  ", "nl\n", "\n", " ", "a\n b", "tab\t x", "it's we'll", "<|endoftext|> hi", "Σας ΑΣ", "\u3000 x \x1c z",
         "5.6,7  !!", "a \n\n b", "Straße Ünd, ÀÉÎ; x.\nFoo, bar", "don't \nit's.", "x" * 100 + " " + "y" * 100, "end. 'tis", "a…, b“,"]


def libraries(name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    return library


@pytest.mark.parametrize("name", FILES)
def test_memory_gives_the_ids_of_the_library(name):
    library, memory = libraries(name), tokens.WordMemory(tokens.library_encoder(public_tokenizers.path(name)), kept=30)
    for _ in range(3):  # also after the memory has been begun anew
        ids, counts = memory.ids(TEXTS)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("name", FILES)
def test_memory_on_random_texts(name):
    library, memory = libraries(name), tokens.library_memory(public_tokenizers.path(name))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet="aBé ß.,'!1\n \t\u00a0Σ日", max_size=30), max_size=5))
    def check(texts):
        ids, counts = memory.ids(texts)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]

    check()


def test_span_hashes_depend_on_the_bytes_alone():
    data = np.frombuffer(b"abc abd abc", np.uint8)
    a, b, c = tokens.span_hashes(data, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert a == c != b


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y <|endoftext|><|endoftext|>\nplain words", "a <|endoftext| > b", "plain words", "<|ENDOFTEXT|> a", "it's <|endoftext|>\n"]


@pytest.mark.parametrize("name", FILES)
def test_special_tokens_as_the_unaltered_library_has_them(name):
    library, memory = Tokenizer.from_file(public_tokenizers.path(name)), tokens.library_memory(public_tokenizers.path(name), special=True)
    for texts in (SPECIAL, TEXTS + SPECIAL, SPECIAL[::-1]):
        ids, counts = memory.ids(texts)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("query, name", [("op6_harmonic_packing", "byte_bpe_50k.json"), ("op9_token_blocks", "word_bpe_49k.json")])
def test_queries_encode_as_the_unaltered_library(spark, folder, query, name):
    from zlib import crc32

    from rillwork.llm.queries import QUERIES

    library = Tokenizer.from_file(public_tokenizers.path(name))
    spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.ids_crc32 for r in QUERIES[query](spark, folder).collect()}
    assert got == {i: crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in enumerate(SPECIAL)}


@pytest.mark.parametrize("name", FILES)
def test_white_space_as_the_library_has_it(name):
    """Runs, tabs and wide spaces that make up for each other in number."""
    library, memory = libraries(name), tokens.library_memory(public_tokenizers.path(name))
    given_texts = ["Name\tQty\tSum\n\n\nTotal", "a\tb\tc\n\n", "a b \n c", " a", "a ", "\na\n", "a  b\nc", "x\x1cy  z", "　", "a\u0085\n b", "’ “a” …\n\n", "a\n"]
    ids, counts = memory.ids(given_texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in given_texts]

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.text(alphabet=" \n\t\rab.  　é’", max_size=16), max_size=8))
    def check(texts):
        ids, counts = memory.ids(texts)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]

    check()


def test_regular_texts_by_rule():
    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.text(alphabet=" \n\t\x1cab\u0085    　é’‐日", max_size=12), max_size=6))
    def check(texts):
        raw = [t.encode() for t in texts]
        got = tokens.regular_texts(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64))
        plain = [not any(c.isspace() and c not in " \n" for c in t) and not any(a.isspace() and b.isspace() for a, b in zip(t, t[1:], strict=False)) for t in texts]
        assert got.tolist() == plain

    check()
