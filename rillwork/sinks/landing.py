"""Tables: appends, staged copies and the idempotent reload of one interval."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import islice
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.intervals import ntz, truncate, within
from rillwork.functions.json_values import record_variant
from rillwork.functions.paths import as_format
from rillwork.functions.urls import unquote
from rillwork.session import settle
from rillwork.sources.files import list_files

# The columns of a landing table.
LANDING_SCHEMA = (
    "src variant, _loaded_at timestamp_ntz, _loaded_from string, "
    "_interval_start timestamp_ntz, _interval_end timestamp_ntz"
)
INTERVAL = ("_interval_start", "_interval_end")
STAGED_SCHEMA = "data_var variant, etl_id string, etl_timestamp timestamp_ntz, etl_filename string"
#: Staged files that one append of ``copy_into_table`` reads: so many names are in the driver at once.
FILES_PER_APPEND = 10_000


def append_rows(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Add rows to a table of files."""
    df.write.mode("append").format(file_format).save(path)


def create_table(spark: SparkSession, name: str, schema: str, path: str) -> str:
    """An external Parquet table over a folder; the name gets a unique ending. Returns the full name."""
    full = f"{name}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {full} ({schema}) USING parquet LOCATION '{path}'")
    return full


def insert_by_position(df: DataFrame, table: str) -> None:
    """Append to a table with columns matched by position; a wrong count is an error."""
    names = df.sparkSession.table(table).columns
    if len(names) != len(df.columns):
        raise ValueError(f"{table} has {len(names)} columns, the rows have {len(df.columns)}")
    df.toDF(*names).write.insertInto(table)


def landing_rows(df: DataFrame, start: str, end: str, loaded_from: Column, loaded_at: Column | None = None) -> DataFrame:
    """Rows as one variant column with interval, load time and origin."""
    at = loaded_at if loaded_at is not None else F.current_timestamp()
    return df.select(
        record_variant(df).alias("src"),
        at.cast("timestamp_ntz").alias("_loaded_at"),
        loaded_from.alias("_loaded_from"),
        ntz(start).alias("_interval_start"),
        ntz(end).alias("_interval_end"),
    )


def swap_interval(rows: DataFrame, path: str, start: str, end: str) -> int:
    """Replace one interval, known by its start and its end, of a landing table by ``rows``; others stay.

    The interval is a partition, swapped when the new files are complete. An interval that has become
    empty gives the swap nothing to replace, so its partition is emptied explicitly. The row count
    comes from the write itself.
    """
    count = Observation()
    writer = rows.observe(count, F.count(F.lit(1)).alias("n")).write.partitionBy(*INTERVAL)
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    loaded = int(count.get["n"])
    if loaded == 0:
        empty_interval(rows.sparkSession, path, start, end)
    return loaded


def empty_interval(spark: SparkSession, path: str, start: str, end: str) -> None:
    """Take the rows of one interval away."""
    nothing = spark.range(0).select(
        F.parse_json(F.lit("null")).alias("src"), ntz(start).alias("_loaded_at"), F.lit("").alias("_loaded_from")
    )
    labels = spark.range(1).select(ntz(start).cast("string"), ntz(end).cast("string")).first()
    folders = "/".join(f"{c}={quote(v, safe=' -.')}" for c, v in zip(INTERVAL, labels))
    nothing.write.mode("overwrite").parquet(f"{path}/{folders}")


def reload_intervals(
    df: DataFrame, path: str, ts: str, intervals: Sequence[tuple[str, str]], loaded_from: Column | None = None
) -> list[int]:
    """Replace several intervals by the rows of ``df`` whose time lies in them, in one pass over the input; returns the
    rows loaded per interval. A row in overlapping intervals belongs to each. The intervals are a short literal list."""
    spans = F.array(*[F.struct(ntz(a).alias("a"), ntz(b).alias("b")) for a, b in intervals])
    held = F.filter(spans, lambda i: within(ts, i["a"], i["b"]))
    rows = df.select("*", F.explode(held).alias("_span")).select(
        record_variant(df).alias("src"),
        F.current_timestamp().cast("timestamp_ntz").alias("_loaded_at"),
        (loaded_from if loaded_from is not None else F.lit(None).cast("string")).alias("_loaded_from"),
        F.col("_span.a").alias("_interval_start"),
        F.col("_span.b").alias("_interval_end"),
    )
    counts = Observation()
    is_one = [(F.col("_interval_start") == ntz(a)) & (F.col("_interval_end") == ntz(b)) for a, b in intervals]
    seen = rows.observe(counts, *[F.count(F.when(c, 1)).alias(f"n{k}") for k, c in enumerate(is_one)])
    writer = seen.hint("rebalance", *INTERVAL).write.partitionBy(*INTERVAL)
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    loaded = [int(counts.get[f"n{k}"]) for k in range(len(intervals))]
    for (start, end), n in zip(intervals, loaded):
        if n == 0:
            empty_interval(df.sparkSession, path, start, end)
    return loaded


def reload_interval(
    df: DataFrame,
    path: str,
    start: str,
    end: str,
    loaded_from: Column | None = None,
    loaded_at: Column | None = None,
) -> int:
    """Load the rows of one interval in place of what the interval held. Running it again changes
    nothing."""
    origin = loaded_from if loaded_from is not None else F.lit(None).cast("string")
    return swap_interval(landing_rows(df, start, end, origin, loaded_at), path, start, end)


def reload_all(df: DataFrame, path: str, ts: str, unit: str = "day", loaded_from: Column | None = None) -> None:
    """Back-fill: every interval that has rows is replaced, all in one pass over the input. Intervals
    without rows are not touched; ``reload_interval`` empties those."""
    start = truncate(ts, unit)
    rows = df.select(
        record_variant(df).alias("src"),
        F.current_timestamp().cast("timestamp_ntz").alias("_loaded_at"),
        (loaded_from if loaded_from is not None else F.lit(None).cast("string")).alias("_loaded_from"),
        start.alias("_interval_start"),
        (start + F.expr(f"INTERVAL 1 {unit}")).alias("_interval_end"),
    )
    writer = rows.hint("rebalance", *INTERVAL).write.partitionBy(*INTERVAL)
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """A landing table; the schema is given because the partition columns would come back zoned."""
    return spark.read.schema(LANDING_SCHEMA).parquet(path)


def copy_into_table(
    spark: SparkSession,
    stage: str,
    path: str,
    etl_id: str,
    loaded: DataFrame | None = None,
    files_per_append: int = FILES_PER_APPEND,
) -> None:
    """Append staged JSON lines (compressed or not) to a table with id, time and file name of the load.

    A file is known by its path below the stage, as names repeat from folder to folder. Loading a file
    again adds it again, unless ``loaded`` (the table so far) is given: then the files that are there
    are dropped from the listing, before anything is read.

    The list of files is a written table, and the driver takes ``files_per_append`` names of it at a time. A load that
    stops between two appends goes on where it stopped if it is run again with ``loaded``.
    """
    files = list_files(spark, stage).select("path")
    if loaded is not None:
        # One row per loaded file on either side; settled, so that it is broadcast only if it is small.
        known = settle(loaded.select(F.col("etl_filename").alias("path")).distinct(), "loaded-files")
        files = files.join(known, "path", "left_anti")
    base = stage.rstrip("/")
    fresh = settle(files, "fresh-files").toLocalIterator()
    begun = spark.range(1).select(F.current_timestamp().cast("timestamp_ntz").cast("string")).first()[0]
    while some := [f"{base}/{r.path}" for r in islice(fresh, files_per_append)]:
        rows = spark.read.text(some).select(
            F.parse_json("value").alias("data_var"),
            F.lit(etl_id).alias("etl_id"),
            ntz(begun).alias("etl_timestamp"),
            as_format(unquote("_metadata.file_path"), base, "relative").alias("etl_filename"),
        )
        rows.write.mode("append").parquet(path)
