import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rillwork.llm import packing
from tests.llm.odd import ODD, no_docs, odd_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 20_000))
def test_cuts_fill_their_slots(total):
    pieces = packing.cuts(total, 2048)
    assert sum(pieces) == total and all(0 < n <= 2048 for n in pieces)
    assert all(2048 // (2048 // n) - n <= 8 for n in pieces)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200))
def test_sequences_hold_whole_classes_or_fit(lengths):
    lengths = np.array(lengths, np.int64)
    classes = 100 // np.maximum(lengths, 1)
    bins, offsets = packing.fill(classes, lengths)
    loose = np.flatnonzero(bins < 0)
    own, offsets[loose] = packing.first_fit(lengths[loose], 100)
    assert all(n == k for b in set(bins[bins >= 0]) for k in [classes[bins == b][0]] for n in [(bins == b).sum()])
    bins[loose] = own + bins.max(initial=-1) + 1
    for b in set(bins.tolist()):
        at = 0
        for i in sorted(np.flatnonzero(bins == b), key=lambda i: offsets[i]):
            assert offsets[i] == at
            at += lengths[i]
        assert at <= 100


def test_every_id_lies_in_one_piece(spark):
    docs = odd_docs(spark).unionByName(odd_docs(spark)).repartition(5)
    rows = packing.pack_documents(docs, PATH).collect()
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    want = Counter()
    for doc_id, text, *_ in ODD * 2:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for n in packing.cuts(len(ids), 2048):
            want[doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)] += 1
            at += n
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 2048) + 2
    assert packing.pack_documents(no_docs(spark), PATH).count() == 0
