"""Comparison of two frames by a tree of hashes.

Rows belong to ranges of a hash of their key. Per range each side has the number of its rows and sums of their hashes, which do
not depend on their order: partial sums, so that no row is moved. Ranges that agree are done with. Ranges that differ are split
into finer ones by a further pass, as long as that leaves rows out; what is left is compared row by row, and then
column by column. Equal frames are read once each and nothing of them is shuffled but a few numbers per range.

Two different ranges of rows pass for equal with odds of about 1 in 2**64.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.operators.relational import compare_frames
from rillwork.session import settle

#: Bits of the key's hash that a pass adds to a range, and passes at most.
BITS, PASSES = 12, 4
#: Rows in differing ranges that are compared without splitting these further.
FEW_ROWS = 100_000
#: Differing ranges that may be broadcast; more of them are joined by a shuffle.
FEW_RANGES = 200_000


@dataclass
class Comparison:
    """What two frames do not have in common. ``ranges`` are the differing ones of the last pass, ``compared`` the rows in them."""

    rows: DataFrame
    columns: DataFrame
    ranges: int
    compared: int


def hashed(columns: Sequence[str], seed: int) -> Column:
    """A hash of the columns that tells nulls from their neighbours."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def in_range(key: Sequence[str], passes: int) -> Column:
    """The range of a row: the leading bits of its key's hash."""
    return F.shiftrightunsigned(hashed(key, 1), 64 - BITS * passes)


def differing(sides: tuple[DataFrame, DataFrame], key: Sequence[str], passes: int, within: DataFrame | None) -> DataFrame:
    """(range, n_rows of both sides) of the ranges that are not the same on both sides."""
    every = []
    for sign, df in zip((1, -1), sides, strict=True):
        row = hashed(df.columns, 2)
        parts = df.select(in_range(key, passes).alias("range"), F.shiftrightunsigned(row, 32).alias("high"), row.bitwiseAND(0xFFFFFFFF).alias("low"), F.lit(sign).alias("sign"))
        every.append(parts if within is None else only(parts, F.shiftrightunsigned("range", BITS), within))
    # A side's sums count against the other's: all are 0 where the range is the same.
    both = every[0].unionByName(every[1]).groupBy("range")
    sums = both.agg(F.count("*").alias("n"), *[F.sum(F.col(c) * F.col("sign")).alias(c) for c in ("high", "low")], F.sum("sign").alias("more"))
    return settle(sums.filter("high <> 0 OR low <> 0 OR more <> 0").select("range", "n"), "differing")


def only(df: DataFrame, place: Column, ranges: DataFrame) -> DataFrame:
    """Rows in these ranges."""
    known = ranges.select(F.col("range").alias("_range"))
    if ranges.count() <= FEW_RANGES:
        known = F.broadcast(known)
    return df.withColumn("_range", place).join(known, "_range", "left_semi").drop("_range")


def compare_by_ranges(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Comparison:
    """Rows that one side has more often than the other (all columns, side, n_rows), as ``compare_frames`` gives them, and
    per column whether it is the same in rows of one key (column, passed, n_different).

    Columns are those of ``left``. A key that one side does not have, or that a side has in several unlike rows, has no
    partner to compare columns with; it counts against the columns of the key, as their values differ as a whole.
    """
    columns, key = left.columns, list(key)
    sides = (left.select(*[f"`{c}`" for c in columns]), right.select(*[f"`{c}`" for c in columns]))
    ranges, rows, found = None, None, 0
    for passes in range(1, PASSES + 1):
        before, ranges = rows, differing(sides, key, passes, ranges)
        total = ranges.agg(F.count("*").alias("found"), F.sum("n").alias("n")).first()
        found, rows = total.found, total.n or 0
        if rows <= FEW_ROWS or (before is not None and 2 * rows > before):
            break
    chosen = [only(df, in_range(key, passes), ranges) for df in sides]
    surplus = settle(compare_frames(*chosen), "surplus")
    return Comparison(surplus, by_column(surplus, columns, key), found, rows)


def by_column(surplus: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """A row per column: in how many keys its value differs."""
    others = [c for c in columns if c not in key]
    of_key = F.struct(*[F.col(f"`{c}`") for c in key]).alias("_key")
    sides = []
    for side in ("left", "right"):
        own = surplus.filter(F.col("side") == side).groupBy(of_key)
        sides.append(own.agg(F.sum("n_rows").alias(f"{side}_n"), F.first(F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in others])).alias(side)))
    met = sides[0].withColumnRenamed("_key", "_a").join(sides[1], F.col("_a").eqNullSafe(F.col("_key")), "full")
    paired = (F.coalesce("left_n", F.lit(0)) == 1) & (F.coalesce("right_n", F.lit(0)) == 1)
    unlike = {c: paired & ~F.col(f"left.`{c}`").eqNullSafe(F.col(f"right.`{c}`")) for c in others}
    unlike |= {c: ~paired for c in key}
    counts = met.agg(*[F.coalesce(F.sum(u.cast("long")), F.lit(0)).alias(f"n{i}") for i, u in enumerate(unlike.values())])
    parts = [counts.select(F.lit(c).alias("column"), (F.col(f"n{i}") == 0).alias("passed"), F.col(f"n{i}").cast("long").alias("n_different")) for i, c in enumerate(unlike)]
    return reduce(lambda a, b: a.unionByName(b), parts)
