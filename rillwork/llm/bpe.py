"""Byte-level BPE by ranks, as merges of length-bucketed padded numpy matrices.

Each row of a matrix is one distinct piece of text. A round looks up the ranks of all adjacent pairs in a hash table,
merges the leftmost pair of minimum rank in every row, closes the gap, and drops the rows that are finished. In wide
matrices a round merges all occurrences of that pair in the rows where this gives the same ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rillwork.llm.common import map_frames, pick_runs, ranges, renamed, text_slices
from rillwork.llm.hashing import KeyTable
from rillwork.llm.tokens import shared_memory

NONE = np.int64(1) << 40
#: Rows up to this length merge one pair a round, longer ones every occurrence of it where that gives the same.
SHORT = 64
#: Matrix cells worked on at a time.
CELLS = 1 << 19


class RankedBytes:
    """Encoder and decoder for a rank file (base64 bytes and rank per line)."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.find = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        parts = [b""] * size
        for token, rank in self.ranks.items():
            parts[rank] = token
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        get = self.ranks.get
        pairs = [(get(t[:i]), get(t[i:]), r) for t, r in self.ranks.items() for i in range(1, len(t))]
        pairs = np.array([p for p in pairs if p[0] is not None and p[1] is not None], np.int64)
        self.pairs = KeyTable(pairs[:, 0] << 20 | pairs[:, 1])
        self.merged = np.append(pairs[:, 2], NONE)  # at -1: no such pair

    def table(self, keys: np.ndarray) -> np.ndarray:
        return self.merged[self.pairs(keys)]

    def pair_ranks(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = self.table(rows[:, :-1] << 20 | rows[:, 1:])
        out[np.arange(rows.shape[1] - 1) >= sizes[:, None] - 1] = NONE
        return out

    def merge(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of padded rows once nothing more merges."""
        done, counts, live = rows.copy(), sizes.copy(), np.arange(len(rows))
        while len(live) and rows.shape[1] > 1:
            ranks = self.pair_ranks(rows, sizes)
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                done[live[over], : rows.shape[1]], counts[live[over]] = rows[over], sizes[over]
                keep = ~over
                rows, sizes, at, best, live, ranks = rows[keep], sizes[keep], at[keep], best[keep], live[keep], ranks[keep]
                if not len(live):
                    break
            if rows.shape[1] > SHORT:
                rows, sizes = self.merge_all(rows, sizes, ranks, best, at)
            else:
                rows[np.arange(len(rows)), at] = best
                column = np.arange(rows.shape[1] - 1)
                rows = np.take_along_axis(rows, column + (column > at[:, None]), axis=1)
                sizes = sizes - 1
            rows = rows[:, : int(sizes.max())]
        done[live, : rows.shape[1]], counts[live] = rows, sizes
        return done, counts

    def merge_all(self, rows, sizes, ranks, best, at):
        """One round for long rows: every occurrence of a row's minimum pair, left to right without overlap.

        That is what one merge at a time gives if no pair that such a merge makes ranks below the minimum; rows where
        one does merge their leftmost occurrence only.
        """
        hit = ranks == best[:, None]
        column = np.arange(hit.shape[1])
        before = np.maximum.accumulate(np.where(hit, -1, column), axis=1)  # last place without a hit
        hit &= (column - before) % 2 == 1
        row, place = np.nonzero(hit)
        new = best[row]
        follows = (place >= 2) & hit[row, np.maximum(place - 2, 0)]
        left = np.where(follows, new, rows[row, np.maximum(place - 1, 0)])
        lower = (place > 0) & (self.table(left << 20 | new) < new)
        right = rows[row, np.minimum(place + 2, rows.shape[1] - 1)]
        lower |= (place + 2 < sizes[row]) & (self.table(new << 20 | right) < new)
        one = np.unique(row[lower])
        hit[one] = column == at[one, None]
        rows[:, :-1] = np.where(hit, best[:, None], rows[:, :-1])
        keep = np.arange(rows.shape[1]) < sizes[:, None]
        keep[:, 1:] &= ~hit
        left = keep.sum(axis=1)
        out = np.zeros((len(rows), int(left.max())), np.int64)
        out[np.repeat(np.arange(len(rows)), left), ranges(left)] = rows[keep]
        return out, left

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, count per piece) of distinct pieces; a piece that is a token itself is that token."""
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        lengths = np.array([len(p) for p in pieces], np.int64)
        flat = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        counts = np.where(whole >= 0, 1, 0)
        places, parts, at = np.zeros(len(pieces), np.int64), [whole[whole >= 0]], int((whole >= 0).sum())
        places[whole >= 0] = np.arange(at)
        rest = np.flatnonzero(whole < 0)
        bucket = np.ceil(np.log2(np.maximum(lengths[rest], 2))).astype(np.int64)
        for b in np.unique(bucket):
            own, step = rest[bucket == b], max(1, CELLS >> int(b))
            for k in range(0, len(own), step):
                some = own[k : k + step]
                n = lengths[some]
                rows = np.zeros((len(some), int(n.max())), np.int64)
                rows[np.repeat(np.arange(len(some)), n), ranges(n)] = pick_runs(flat, starts[some], n)
                ids, left = self.merge(rows, n)
                parts.append(ids[np.arange(ids.shape[1]) < left[:, None]])
                counts[some], places[some] = left, at + np.cumsum(left) - left
                at += int(left.sum())
        return pick_runs(np.concatenate(parts), places, counts).astype(np.uint32), counts

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, count per chunk): each match of the pattern separately, distinct ones once."""
        found = [self.find(c) for c in parts]
        sizes = np.array([len(x) for x in found], np.int64)
        every = [p for x in found for p in x]
        place = {p: i for i, p in enumerate(dict.fromkeys(every))}
        ids, counts = self.pieces([p.encode() for p in place])
        index = np.fromiter(map(place.__getitem__, every), np.int64, len(every))
        starts = np.cumsum(counts) - counts
        lengths = counts[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)]
        return pick_runs(ids, starts[index], lengths), np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray) -> bytes:
        return pick_runs(self.flat, self.starts[ids], self.lengths[ids]).tobytes()


_CODERS: dict[tuple[str, str], RankedBytes] = {}


def coder(path: str, pattern: str) -> RankedBytes:
    """The coder of a worker process, built once."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = RankedBytes(path, pattern)
    return _CODERS[path, pattern]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                       T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
IDS_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])


def encode_texts(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the ids of the whole text as little-endian unsigned 32-bit integers.

    A null text is an empty one and has no ids. Rows are handled one by one: null or repeated doc_ids and repeated rows
    stay as they are, other columns are not read, an empty table gives an empty one. ``path`` is the rank file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = shared_memory(("ranks", path, pattern), lambda: coder(path, pattern).encode)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, b in text_slices(texts):
                ids, counts = memory.ids(texts[a:b])
                cuts = np.cumsum(counts)[:-1]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].array, "ids": [x.astype("<u4").tobytes() for x in np.split(ids, cuts)]})

    return map_frames(renamed(docs, doc_id=doc_id, text=text), run, IDS_SCHEMA)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the decoded bytes of ``encode_texts`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(path, pattern)
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.iloc[a : a + 256]
                yield some.assign(decoded=[own.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in some["ids"]])

    return map_frames(encoded, run, T.StructType([*IDS_SCHEMA.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded bytes; cases as in ``encode_texts``. Both ways run in
    one Python worker per task: in two, each would come to hold the vocabulary and a memory of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, memory = coder(path, pattern), shared_memory(("ranks", path, pattern), lambda: coder(path, pattern).encode)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, b in text_slices(texts):
                flat, counts = memory.ids(texts[a:b])
                ids = [x.astype("<u4") for x in np.split(flat, np.cumsum(counts)[:-1])]
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b].array,
                    "n_tokens": counts,
                    "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(own.decode(x.astype(np.int64))).hexdigest() for x in ids],
                })

    return map_frames(renamed(docs, doc_id=doc_id, text=text), run, SCHEMA)
