"""Pairs of names that differ in a few characters.

Two names of T characters together with a score above a threshold leave at most so many characters unmatched, in both together. Whatever
their order, the two names are equal as bags of characters once these are taken away. So a name's keys are sums over its characters, less any few
of them: two names meet where the same is left of both, and just once, as what was taken from one must not be in
what was taken from the other. That tells names apart by all they hold, so it does not matter how many share a word.

Taking one or none from a name makes few keys, taking more makes hundreds. Those of the second kind are kept only if the other side
may have them: its few keys are marked in a filter of bits, of one size whatever the tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.session import fresh_dir, settle
from rillwork.storage import open_path

#: Characters that may be left unmatched in both names together; pairs with more are found by grams.
FEW = 4
#: Kinds of characters: letters, digits and the blank have their own, others share them.
KINDS = 53
KIND = np.array([c - 97 if 97 <= c <= 122 else c - 22 if 48 <= c <= 57 else 36 if c == 32 else 37 + c % 16 for c in range(128)])
#: Sums of up to four of these are all different, so that no pair meets twice.
WEIGHTS = np.array([int.from_bytes(sha256(bytes([k])).digest()[:8], "little") for k in range(KINDS)], dtype=np.uint64)
#: Bits of a filter, as a power of two.
BITS = 28
#: Keys that are worked on at a time.
PIECE = 500_000


def left_over(characters, bar: int):
    """The most characters left unmatched among so many in both names; ``bar`` as in ``similarity.Bounds``."""
    least = F.ceil(characters * bar / 400) if isinstance(characters, Column) else -(-characters * bar // 400)
    return characters - 2 * least


@cache
def most_from_other(size: int, out: int, bar: int) -> int:
    """The most characters that may be taken from a partner of a name that ``out`` of ``size`` are taken from; -1 without a partner."""
    rest = size - out
    fits = [j for j in range(FEW - out + 1) if out + j <= left_over(2 * rest + out + j, bar) <= FEW]
    return max(fits, default=-1) if rest > 0 else -1


@cache
def choices(kinds: int, out: int) -> tuple[np.ndarray, np.ndarray]:
    """All ways to take ``out`` characters of so many kinds, and how many of its kind each of them follows."""
    listed = list(combinations_with_replacement(range(kinds), out))
    ways = np.array(listed, dtype=np.int64).reshape(len(listed), out)
    before = np.zeros_like(ways)
    for c in range(1, out):
        before[:, c] = np.where(ways[:, c] == ways[:, c - 1], before[:, c - 1] + 1, 0)
    return ways, before


def shortened(names: list[str], bar: int, outs: range) -> Iterator[tuple]:
    """(rows, out, most, keys, kinds, held) of pieces: the keys of these rows, a column per way to take ``out`` characters."""
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    sizes = np.array([len(x) for x in names])
    kind = np.where(codes < 128, KIND[np.minimum(codes, 127)], codes % KINDS)
    counts = np.bincount(np.repeat(np.arange(len(names)), sizes) * KINDS + kind, minlength=len(names) * KINDS).reshape(-1, KINDS)
    total = (counts.astype(np.uint64) * WEIGHTS).sum(axis=1, dtype=np.uint64)
    several = (counts > 0).sum(axis=1)
    alike = sizes * (KINDS + 1) + several
    order = np.argsort(alike, kind="stable")
    for every in np.split(order, np.flatnonzero(np.diff(alike[order])) + 1):
        size, many = int(sizes[every[0]]), int(several[every[0]])
        for out in outs:
            most = most_from_other(size, out, bar)
            if most < 0:
                continue
            ways, _ = choices(many, out)
            step = max(1, PIECE // len(ways))
            for begin in range(0, len(every), step):
                rows = every[begin : begin + step]
                kinds = np.nonzero(counts[rows])[1].reshape(len(rows), many)
                weights = WEIGHTS[kinds]
                keys = np.repeat(total[rows][:, None], len(ways), axis=1)
                for c in range(out):
                    keys -= weights[:, ways[:, c]]
                yield rows, out, most, keys, kinds, np.take_along_axis(counts[rows], kinds, 1)


def marks(names: DataFrame, bar: int) -> str:
    """Path of the filter of the keys with none or one character taken: (out, word, bits)."""

    def make(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for _, out, _, keys, _, _ in shortened(batch.column(0).to_pylist(), bar, range(2)):
                spots = np.unique(keys >> np.uint64(64 - BITS))
                words = spots >> np.uint64(6)
                first = np.flatnonzero(np.diff(words, prepend=words[0] + np.uint64(1)))
                bits = np.bitwise_or.reduceat(np.uint64(1) << (spots & np.uint64(63)), first)
                yield pa.record_batch({"out": np.full(len(first), out, dtype=np.int32), "word": words[first].astype(np.int64), "bits": bits.view(np.int64)})

    path = fresh_dir(names.sparkSession, "marks")
    every = names.select("name").mapInArrow(make, "out int, word long, bits long")
    every.groupBy("out", "word").agg(F.bit_or("bits").alias("bits")).write.parquet(path)
    return path


_FILTERS: dict[str, list[np.ndarray]] = {}


def filters(path: str) -> list[np.ndarray]:
    """The bits of keys with no character taken, and of those with none or one. A worker holds those of one path."""
    if path not in _FILTERS:
        _FILTERS.clear()
        system, place = open_path(path)
        made = [np.zeros(1 << (BITS - 6), dtype=np.uint64) for _ in range(2)]
        files = [x.path for x in system.get_file_info(fs.FileSelector(place)) if x.path.endswith(".parquet")]
        for file in files:
            with system.open_input_file(file) as opened:
                for batch in pq.ParquetFile(opened).iter_batches():
                    out, word, bits = (c.to_numpy() for c in batch.columns)
                    for level in range(2):
                        made[level][word[out == level]] |= bits[out == level].view(np.uint64)
        made[1] |= made[0]
        _FILTERS[path] = [x.view(np.uint8) for x in made]
    return _FILTERS[path]


def entries(names: DataFrame, other: str, bar: int) -> DataFrame:
    """(key, taken, out, name): the keys of each name that the other side, whose marks are given, may have, too."""

    def make(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            for rows, out, most, keys, kinds, held in shortened(column.to_pylist(), bar, range(FEW + 1)):
                ways, before = choices(kinds.shape[1], out)
                if most <= 1:
                    known = filters(other)[most][(keys >> np.uint64(67 - BITS)).astype(np.int64)]
                    at, way = np.nonzero(known >> ((keys >> np.uint64(64 - BITS)) & np.uint64(7)).astype(np.uint8) & 1)
                else:
                    at, way = (x.ravel() for x in np.indices(keys.shape))
                had = (held[at[:, None], ways[way]] > before[way]).all(axis=1)
                at, way = at[had], way[had]
                taken = np.bitwise_or.reduce(np.int64(1) << kinds[at[:, None], ways[way]], axis=1, initial=0)
                yield pa.record_batch(
                    {
                        "key": keys[at, way].view(np.int64),
                        "taken": taken.astype(np.int64),
                        "out": np.full(len(at), out, dtype=np.int32),
                        "name": column.take(pa.array(rows[at])),
                    }
                )

    return names.select("name").mapInArrow(make, "key long, taken long, out int, name string")


def near_pairs(left: DataFrame, right: DataFrame, bar: int, deal) -> DataFrame:
    """(left_name, right_name): distinct pairs of unlike names that at most ``FEW`` characters, and no more than the bar allows, are left of.
    ``deal`` splits keys that very many names have."""
    # The tables of names are small for the work to be done on them.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (side.filter(F.col("size") > 0).select("name").repartition(tasks, "name") for side in (left, right))
    known = [marks(side, bar) for side in (left, right)]
    a, b = (settle(entries(side, other, bar), "spelling") for side, other in ((left, known[1]), (right, known[0])))
    a, b = (side.toDF("key", *[f"{name}_{c}" for c in ("taken", "out", "name")]) for name, side in (("left", a), ("right", b)))
    a, b = deal(a, b, "key", "left_name")
    one, other = F.col("left_name"), F.col("right_name")
    allowed = left_over(F.char_length(one) + F.char_length(other), bar)
    differ = F.levenshtein(one, other, FEW)
    met = a.join(b, ["key", "salt"]).filter(
        (F.col("left_taken").bitwiseAND(F.col("right_taken")) == 0)
        & (F.col("left_out") + F.col("right_out") <= allowed)
        & (allowed <= FEW)
        & (one != other)
        & differ.between(0, allowed)
    )
    return met.select("left_name", "right_name")
