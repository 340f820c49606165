"""The score of ``functions.text`` for many pairs at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.functions.text import score

#: From this length on ``difflib`` leaves out frequent characters; such texts are left to it.
LONG = 200
#: Regions that are searched at a time.
PIECE = 4096


def code_points(texts: list[str], filler: int) -> np.ndarray:
    """A row per text, filled up with a number that is no character."""
    sizes = np.array([len(x) for x in texts])
    out = np.full((len(texts), max(1, sizes.max())), filler, dtype=np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out


def longest_blocks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, size) of the longest common block of each row, the first one in a, then in b."""
    run = np.zeros((len(a), b.shape[1] + 1), dtype=np.int16)
    size, i, j = (np.zeros(len(a), dtype=np.int64) for _ in range(3))
    for at in range(a.shape[1]):
        run[:, 1:] = (run[:, :-1] + 1) * (a[:, at : at + 1] == b)
        longer = np.flatnonzero(run.max(axis=1) > size)
        if len(longer):
            end = run[longer].argmax(axis=1)
            size[longer] = run[longer, end]
            i[longer], j[longer] = at + 1 - size[longer], end - size[longer]
    return i, j, size


def matched(lefts: list[str], rights: list[str]) -> np.ndarray:
    """Matched characters of each pair: the longest block, then those left of it, then those right of it, and so on."""
    a, b = code_points(lefts, 0xFFFFFFFF), code_points(rights, 0xFFFFFFFE)
    out = np.zeros(len(lefts), dtype=np.int64)
    # Rows of pair, begin and end in a, begin and end in b.
    todo = np.array([np.arange(len(lefts)), [0] * len(lefts), list(map(len, lefts)), [0] * len(lefts), list(map(len, rights))]).T
    while len(todo := todo[(todo[:, 2] > todo[:, 1]) & (todo[:, 4] > todo[:, 3])]):
        todo = todo[np.argsort(todo[:, 2] - todo[:, 1] + todo[:, 4] - todo[:, 3])]
        found = []
        for part in (todo[k : k + PIECE] for k in range(0, len(todo), PIECE)):
            pair, a0, a1, b0, b1 = part.T
            sides = []
            for codes, begin, end, filler in ((a, a0, a1, 0xFFFFFFFF), (b, b0, b1, 0xFFFFFFFE)):
                spots = begin[:, None] + np.arange((end - begin).max())
                cut = codes[pair[:, None], np.minimum(spots, codes.shape[1] - 1)]
                sides.append(np.where(spots < end[:, None], cut, np.uint32(filler)))
            i, j, size = longest_blocks(*sides)
            np.add.at(out, pair, size)
            left = np.array([pair, a0, a0 + i, b0, b0 + j]).T
            right = np.array([pair, a0 + i + size, a1, b0 + j + size, b1]).T
            found += [left[size > 0], right[size > 0]]
        todo = np.concatenate(found)
    return out


def scores(lefts: list[str], rights: list[str]) -> np.ndarray:
    """``score`` of each pair."""
    lefts, rights = [x.lower() for x in lefts], [x.lower() for x in rights]
    out = np.zeros(len(lefts), dtype=np.int32)
    short = np.array([bool(a) and bool(b) and a != b and max(len(a), len(b)) < LONG for a, b in zip(lefts, rights)], dtype=bool)
    for k in np.flatnonzero(~short):
        out[k] = score(lefts[k], rights[k])
    if short.any():
        a, b = ([side[k] for k in np.flatnonzero(short)] for side in (lefts, rights))
        characters = np.array([len(x) + len(y) for x, y in zip(a, b)])
        out[short] = np.rint(100 * (2.0 * matched(a, b) / characters))
    return out


@F.pandas_udf(T.IntegerType())
def measured_at_once(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``measured`` for pairs without nulls."""
    for left, right in batches:
        yield pd.Series(scores(left.tolist(), right.tolist()), dtype="int32")
