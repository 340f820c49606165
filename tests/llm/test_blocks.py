import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rillwork.llm import blocks
from tests.llm.odd import ODD, no_docs, odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2500), st.integers(1, 2**32 - 1)), min_size=1, max_size=6), st.integers(0, 9))
def test_files_give_back_what_went_in(documents, seed):
    rng = np.random.default_rng(seed)
    ids = [rng.integers(0, most, n, dtype=np.uint32) for n, most in documents]
    doc_ids = np.array([None if i % 3 == 2 else i for i in range(len(ids))], object)
    file = blocks.TokenFile(blocks.to_file(3, 17, doc_ids, np.array([len(x) for x in ids]), np.concatenate(ids)))
    before = 17
    for (doc_id, at, got), want_id, want in zip(file.documents(), doc_ids, ids, strict=True):
        assert (doc_id, at, got.tolist()) == (want_id, before, want.tolist())
        assert file.read(at - 17, len(want)).tolist() == want.tolist()
        before += len(want)
    assert file.partition == 3


def test_few_large_values_are_exceptions():
    ids = np.full(blocks.BLOCK, 7, np.uint32)
    ids[5], ids[900] = 4_000_000_000, 9
    data = blocks.pack(ids)[0]
    assert len(data) < 40 and blocks.unpack_block(memoryview(data)).tolist() == ids.tolist()


def test_written_files_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FILE_IDS", 3)
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    want, start = [], 0
    for doc_id, text, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, blocks.written_and_read(odd_docs(spark), PATH).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == want
    assert blocks.written_and_read(no_docs(spark), PATH).count() == 0
