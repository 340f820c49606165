"""Batch numbers, chunks, order and limits per key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.session import settle

# Rows that one task sorts, about.
ROWS_PER_TASK = 500_000
# Parts that a key is dealt to before its first rows are picked.
SALTS = 32
# Fixed layout of Spark's increasing ids: the partition above these bits, the row in the partition below them.
PARTITION_BITS = 33


def _window(group: Sequence[str], order: Sequence[str], descending: bool, *extra: Column):
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    return Window.partitionBy(*extra, *group).orderBy(*by)


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    alias: str = "batch_num",
    descending: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """1-based running number per group, for frames and groups of any size. The rows are written before they are cut, so
    that what makes them runs once.

    ``order`` must be unique within a group. The rows are cut along the sort order (group, order) into ranges, in
    proportion to their number, so that a group holding a third of all rows becomes many ranges. The sorted ranges are
    written once; a row's place in its range is then fixed. The number of a row is its place, less the first place of its
    group there, plus the rows of the group in earlier ranges. These two come from one row per group and range, which is
    joined back: a broadcast where that table is small, else a shuffled join whose keys hold the range, so that no key is
    large. With no group the last step sums up one row per range.
    """
    df = settle(df, "rows")
    slices = max(1, math.ceil(df.count() / rows_per_task))
    by = [*[F.asc(c) for c in group], *[F.desc(c) if descending else F.asc(c) for c in order]]
    ranged = df.repartitionByRange(slices, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = settle(ranged.withColumn("_range", F.shiftright("_at", PARTITION_BITS)), "ranges")

    per_range = placed.groupBy("_range", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1
    offsets = settle(
        per_range.select(F.col("_range").alias("_in"), *[F.col(c).alias(f"_of_{c}") for c in group], ahead.alias("_ahead")), "offsets"
    )
    same = [F.col("_range") == F.col("_in"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]]
    return placed.join(offsets, same).select(*df.columns, (F.col("_at") + F.col("_ahead")).cast("long").alias(alias))


def chunk_rows(
    df: DataFrame,
    size: int,
    group: Sequence[str],
    order: Sequence[str],
    alias: str = "batch_num",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Consecutive numbered batches of ``size`` rows per group."""
    if size < 1:
        raise ValueError("batch size must be positive")
    numbered = number_rows(df, group, order, "_row", rows_per_task=rows_per_task)
    number = F.floor((F.col("_row") - 1) / F.lit(size)).cast("long") + F.lit(1)
    return numbered.withColumn(alias, number).drop("_row")


def batch_summary(df: DataFrame, size: int, group: Sequence[str]) -> DataFrame:
    """Batches of ``size`` rows and rows per group. A count decides it; no row needs a number."""
    return df.groupBy(*group).agg(F.count("*").alias("n_rows")).withColumn(
        "n_batches", F.ceil(F.col("n_rows") / F.lit(size)).cast("long")
    )


def order_batches(df: DataFrame, group: Sequence[str], number: str = "batch_num") -> DataFrame:
    """Rows by group and batch number, compared as numbers. A range sort: a large group spreads over
    several partitions."""
    return df.orderBy(*group, number)


def limit_per_key(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    n: int,
    descending: bool = False,
    alias: str | None = None,
) -> DataFrame:
    """At most ``n`` rows per key.

    A key's rows are dealt to ``SALTS`` parts and each part keeps its first ``n``, so that no task sorts all rows of a
    hot key; the key's first ``n`` are then picked from these. Up to Spark's own limit every map task trims its rows
    beforehand as well.
    """
    name = alias or "_row"
    salt = F.pmod(F.xxhash64(*order), F.lit(SALTS))
    part = df.withColumn("_salt", salt).withColumn("_place", F.row_number().over(_window(key, order, descending, F.col("_salt"))))
    kept = part.filter(F.col("_place") <= n).drop("_place", "_salt")
    numbered = kept.withColumn(name, F.row_number().over(_window(key, order, descending))).filter(F.col(name) <= n)
    return numbered.withColumn(alias, F.col(alias).cast("long")) if alias else numbered.drop(name)
