"""Text measures."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Runs of what Python's regular expressions take for white space: Unicode white space as Java knows it,
# and the four separators that only Python counts.
WHITE_SPACE = "(?U)[\\s\\x1c-\\x1f]+"


def word_count(text: Column | str) -> Column:
    """Pieces between runs of white space. Leading and trailing space give an empty piece that counts."""
    text = F.col(text) if isinstance(text, str) else text
    return F.size(F.split(text, WHITE_SPACE)).cast("long")


def score(left: str, right: str) -> int:
    """Similarity 0..100 of two lower-cased names: twice the matched characters over all characters."""
    left, right = left.lower(), right.lower()
    if left == right:
        return 100
    if not left or not right:
        return 0
    return int(round(100 * SequenceMatcher(None, left, right).ratio()))


@F.pandas_udf(T.IntegerType())
def _score_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series(
            [None if a is None or b is None else score(a, b) for a, b in zip(left, right)], dtype="Int32"
        )


def measured(left: Column | str, right: Column | str) -> Column:
    """Similarity score of two columns; null where a side is missing."""
    return _score_batches(left, right)


def similarity(left: Column | str, right: Column | str) -> Column:
    """Similarity score of two columns; 0 where a side is missing."""
    return F.coalesce(_score_batches(left, right), F.lit(0))


def is_similar(left: Column | str, right: Column | str, threshold: int) -> Column:
    """Whether the score is strictly above the threshold.

    Only pairs that could pass reach Python: equal texts are decided by comparison, and the lengths
    alone bound the score from above (all characters of the shorter text matched).
    """
    left = F.lower(F.col(left) if isinstance(left, str) else left)
    right = F.lower(F.col(right) if isinstance(right, str) else right)
    shorter = F.least(F.char_length(left), F.char_length(right))
    best = 200.0 * shorter / (F.char_length(left) + F.char_length(right))
    equal = F.coalesce(left == right, F.lit(False))
    open_pair = ~equal & F.coalesce(F.ceil(best) > F.lit(threshold), F.lit(False))
    measured = _score_batches(F.when(open_pair, left), F.when(open_pair, right))
    return F.when(equal, F.lit(100 > threshold)).otherwise(F.coalesce(measured > F.lit(threshold), F.lit(False)))
