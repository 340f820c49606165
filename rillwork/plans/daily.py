"""Extract one interval, keep the wanted message types, land them idempotently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.functions.json_values import pick
from rillwork.session import fresh_dir
from rillwork.sinks.landing import read_landing, reload_intervals


def extract_route_reload(
    df: DataFrame, ts: str, type_column: str, kinds: Sequence[str], intervals: Sequence[tuple[str, str]], landing: str
) -> None:
    """All intervals from one pass over the table; the type is a field of the landed record, so one landing table serves
    all types."""
    reload_intervals(df.filter(F.col(type_column).isin(*kinds)), landing, ts, intervals)


def landed_per_type(df: DataFrame, kinds: Sequence[str], intervals: Sequence[tuple[str, str]]) -> DataFrame:
    """Load the intervals of an event table, the last one twice, and count what the table holds."""
    spark = df.sparkSession
    landing = fresh_dir(spark, "landing")
    for some in (intervals, intervals[-1:]):
        extract_route_reload(df, "ts", "event_type", kinds, some, landing)
    return read_landing(spark, landing).groupBy(
        "_interval_start", pick(F.col("src"), "$.event_type").alias("event_type")
    ).agg(F.count("*").alias("n_rows"))
