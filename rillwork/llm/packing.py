"""Harmonic packing of documents into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of (capacity/(k+1), capacity/k] tokens, and each of
its sequences takes exactly k pieces, so a worker fills sequences class by class without asking anybody. A document is
first cut into whole sequences and a rest; a rest in a low class is cut once more at exactly capacity/(k+1), which
fills its slot, until what remains is in a class whose slots waste little. What does not fill a sequence on its worker
goes on to groups of workers, which fill classes again and put the last few pieces together first-fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import groups_of, map_frames, renamed, text_slices
from rillwork.llm.tokens import library_memory
from rillwork.session import settle

#: Rests below this class are cut at the slot of the next class. 16: a slot wastes 7 of 2048 tokens at most.
LEAST_CLASS = 16
#: Workers whose left-over pieces meet in one task; each leaves fewer than 10,000 of them (the sum of k - 1 over classes).
WORKERS = 8

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("class", T.LongType()),
    T.StructField("worker", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType()),
])


def cuts(total: int, capacity: int, least: int = LEAST_CLASS) -> list[int]:
    """Piece lengths of a document of ``total`` tokens."""
    out, rest = [capacity] * (total // capacity), total % capacity
    while rest:
        k = capacity // rest
        slot = capacity // (k + 1)
        if k >= least or rest == capacity // k:
            out.append(rest)
            break
        out.append(slot)
        rest -= slot
    return out


def fill(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece: k pieces of class k to a sequence in the given order, -1 for the last few
    that do not make one. Sequences are numbered from 0."""
    bins, offsets = np.full(len(classes), -1, np.int64), np.zeros(len(classes), np.int64)
    order = np.argsort(classes, kind="stable")
    own, used = classes[order], 0
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    for a, b in zip(starts, np.append(starts, len(own))[1:], strict=True):
        k = int(own[a])
        full = (b - a) // k
        some = order[a : a + full * k]
        bins[some] = used + np.arange(full * k) // k
        sizes = lengths[some].reshape(full, k)
        offsets[some] = (np.cumsum(sizes, axis=1) - sizes).ravel()
        used += full
    return bins, offsets


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, longest first into the fullest sequence with room."""
    import bisect

    bins, offsets, rooms = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    used: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, (n, -1))
        room, number = rooms.pop(at) if at < len(rooms) else (capacity, len(used))
        if number == len(used):
            used.append(0)
        bins[i], offsets[i] = number, used[number]
        used[number] += n
        if room > n:
            bisect.insort(rooms, (room - n, number))
    return bins, offsets


def pack_documents(
    docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, least: int = LEAST_CLASS, doc_id: str = "doc_id", text: str = "text", special: bool = False
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Whole texts are encoded with the library's vocabulary at ``path`` (strings of its special tokens as these tokens if
    ``special``, else as ordinary text) and end with ``end_id``; a null or empty text has
    that id alone. Every row is packed for itself, so null or repeated doc_ids and repeated rows stay apart; an empty
    table has no pieces; other columns are not read. Each id lies in one piece, each piece in one sequence. The pieces
    are written once: sequences of a repeated task are those of the first try.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        memory, worker, used = library_memory(path, special), TaskContext.get().partitionId(), 0
        rest: pd.DataFrame | None = None
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            keys = batch["doc_id"].array
            for a, b in text_slices(texts):
                flat, counts = memory.ids(texts[a:b])
                made = pieces_of(keys[a:b], flat, counts)
                if rest is not None:
                    made = pd.concat([rest, made], ignore_index=True)
                bins, offsets = fill(made["class"].to_numpy(), made["length"].to_numpy())
                full = bins >= 0
                yield made[full].assign(worker=worker, bin=used + bins[full], offset=offsets[full])
                used += int(bins.max(initial=-1)) + 1
                rest = made[~full]
        if rest is not None:
            yield rest.assign(worker=worker, bin=pd.NA, offset=0).astype({"bin": "Int64"})

    def pieces_of(keys, flat: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        lists = [cuts(int(n) + 1, capacity, least) for n in counts]
        n_pieces = np.array([len(x) for x in lists], np.int64)
        lengths = np.array([n for x in lists for n in x], np.int64)
        out = np.full(len(flat) + len(counts), end_id, "<u4")
        out[np.repeat(np.arange(len(counts)), counts) + np.arange(len(flat))] = flat
        ends = np.cumsum(lengths)
        doc_at = np.repeat(np.cumsum(counts + 1) - counts - 1, n_pieces)
        view = memoryview(out.tobytes())
        crcs = [zlib.crc32(view[4 * int(e - n) : 4 * int(e)]) for e, n in zip(ends, lengths, strict=True)]
        return pd.DataFrame({
            "doc_id": keys.take(np.repeat(np.arange(len(counts)), n_pieces)), "start": ends - lengths - doc_at, "length": lengths,
            "ids_crc32": crcs, "doc_tokens": np.repeat(counts + 1, n_pieces), "class": capacity // lengths,
        })

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in groups_of(batches, ["worker"]):
            for _, group in some.groupby("worker", sort=False):
                lengths = group["length"].to_numpy()
                bins, offsets = fill(group["class"].to_numpy(), lengths)
                loose = np.flatnonzero(bins < 0)
                own, offsets[loose] = first_fit(lengths[loose], capacity)
                bins[loose] = own + bins.max(initial=-1) + 1
                yield group.assign(bin=bins, offset=offsets)

    pieces = settle(map_frames(renamed(docs, doc_id=doc_id, text=text), run, PIECES), "pieces")
    group = F.floor(F.col("worker") / WORKERS)
    loose = pieces.filter("bin IS NULL").withColumn("worker", group).repartition("worker").sortWithinPartitions("worker", "class", "doc_id", "start")
    columns = [F.col(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    # Even numbers for sequences of one worker, odd ones for those of a group.
    local = pieces.filter("bin IS NOT NULL").select(*columns, ((F.col("worker") * (1 << 40) + F.col("bin")) * 2).alias("sequence_id"), "offset")
    shared = map_frames(loose, finish, PIECES).select(*columns, ((F.col("worker") * (1 << 40) + F.col("bin")) * 2 + 1).alias("sequence_id"), "offset")
    return local.unionByName(shared)
