"""Group statistics, lookups and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.operators.batches import limit_per_key


def group_mean(df: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    """Mean per group; rows without key and values that are null do not count."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(alias))


def join_group_stat(df: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    """Every row with the mean of its group; rows without key drop out.

    The means are computed with partial aggregation. AQE sees their true size before it joins: small means are broadcast
    and the rows never sorted, large ones are joined by shuffle. A window would send every row of a group to one task.
    """
    return df.join(group_mean(df, key, value, alias), key, "inner")


def chained_lookup(
    parents: DataFrame,
    children: DataFrame,
    parent_key: str,
    child_key: str,
    order: Sequence[str],
    limit: int = 50,
    descending: bool = False,
) -> DataFrame:
    """Up to ``limit`` child rows for each parent.

    Children without a parent are dropped first, the others limited: the limit trims each key on the map side, and the
    join reuses the partitioning of the limited rows.
    """
    wanted = children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi").select(*children.columns)
    limited = limit_per_key(wanted, [child_key], order, limit, descending, alias="child_num")
    return parents.join(limited, F.col(parent_key) == F.col(child_key), "inner")


def pivot_rows(df: DataFrame, key: Sequence[str], column: str, values: Sequence[str], value: Column) -> DataFrame:
    """One column per listed value. The values are given, so no pass is spent on finding them."""
    return df.groupBy(*key).pivot(column, list(values)).agg(value)


def melt_columns(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """One row per id and value column."""
    return df.unpivot(list(ids), list(values), variable, value)


def compare_frames(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side and the surplus.

    Both sides go through one aggregation with signed counts (duplicates shrink on the map side)
    instead of two ``exceptAll`` passes. No rows means the frames are equal.
    """
    columns = left.columns
    signed = left.withColumn("_sign", F.lit(1)).unionByName(right.withColumn("_sign", F.lit(-1)))
    surplus = signed.groupBy(*columns).agg(F.sum("_sign").alias("_surplus")).filter("_surplus <> 0")
    return surplus.select(
        *columns,
        F.when(F.col("_surplus") > 0, "left").otherwise("right").alias("side"),
        F.abs("_surplus").alias("n_rows"),
    )
