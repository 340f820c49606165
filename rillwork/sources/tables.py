"""Tables: interval extracts, SQL texts and JDBC."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.intervals import within


def read_interval(df: DataFrame, ts: str, start: str, end: str, day_column: str | None = None) -> DataFrame:
    """Rows of one run interval, start inclusive and end exclusive.

    Spark does not skip Parquet row groups on zone-less timestamps. For a large table partitioned by
    day, name that column: the predicate is repeated on it and the other partitions are not read.
    """
    rows = df.filter(within(ts, start, end))
    if day_column is None:
        return rows
    first, last = (F.lit(t).cast("timestamp_ntz").cast("date") for t in (start, end))
    return rows.filter((F.col(day_column) >= first) & (F.col(day_column) <= last))


def run_sql_template(spark: SparkSession, text: str, tables: Sequence[str], column: str = "table_name", **values: Any) -> DataFrame:
    """Run one SQL text per table. The table is ``IDENTIFIER(:table)`` and values are named markers, so
    nothing is pasted into the text."""
    parts = [
        spark.sql(text, args={"table": table, **values}).withColumn(column, F.lit(table)) for table in tables
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def table_columns(spark: SparkSession, table: str) -> DataFrame:
    """Position and name of a table's columns. The catalog knows them; no probe query is run."""
    names = spark.table(table).columns
    return spark.createDataFrame(list(enumerate(names, start=1)), "position int, name string")


def jdbc_options(
    url: str,
    table: str,
    batch_size: int = 10_000,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int | None = None,
) -> dict[str, str]:
    """Options of Spark's JDBC source.

    ``batch_size`` is the number of rows per round trip. With a partition column the table is read by
    ``partitions`` parallel queries; without one a single task reads everything, so give one for any
    table that is not small.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(batch_size)}
    for key, value in (("user", user), ("password", password), ("driver", driver)):
        if value is not None:
            options[key] = value
    if partition_column is not None:
        if bounds is None or partitions is None:
            raise ValueError("a partition column needs bounds and a number of partitions")
        low, high = (b.isoformat(sep=" ") if isinstance(b, datetime) else str(b) for b in bounds)
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": low,
            "upperBound": high,
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, **settings: Any) -> DataFrame:
    """A database table; filters and columns are pushed into the query."""
    return spark.read.format("jdbc").options(**jdbc_options(**settings)).load()


def append_jdbc(df: DataFrame, **settings: Any) -> None:
    """Append rows to a database table."""
    options = jdbc_options(**settings)
    options["batchsize"] = options.pop("fetchsize")
    df.write.format("jdbc").options(**options).mode("append").save()
