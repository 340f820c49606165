"""Aggregation by run interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions.intervals import calendar, interval_tick, next_tick, truncate
from rillwork.session import settle


def tumbling(df: DataFrame, ts: str, schedule: str, *aggregates: Column) -> DataFrame:
    """Aggregate per run interval of a schedule: ``rate(45 minutes)``, ``@weekly``, ``@monthly`` and so on."""
    grouped = df.groupBy(interval_tick(ts, schedule).alias("interval_start")).agg(*aggregates)
    return grouped.select("interval_start", next_tick("interval_start", schedule).alias("interval_end"), *grouped.columns[1:])


def interval_calendar(df: DataFrame, ts: str, unit: str, *aggregates: Column) -> DataFrame:
    """All intervals between the first and the last row, with aggregates (null where nothing came).

    The aggregates are settled, one row per interval, so that the rows are read once although the
    result needs both their range and their values.
    """
    start = truncate(ts, unit)
    per_interval = settle(df.groupBy(start.alias("interval_start")).agg(*aggregates), "per-interval")
    ends = per_interval.agg(F.min("interval_start").alias("first"), F.max("interval_start").alias("last"))
    return calendar(ends, "first", "last", unit).join(per_interval, "interval_start", "left")
