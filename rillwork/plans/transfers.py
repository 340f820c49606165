"""Table to files, files to table, table to warehouse landing, compress and copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions import paths
from rillwork.functions.intervals import ntz
from rillwork.functions.json_values import record_text
from rillwork.functions.urls import quote
from rillwork.operators.batches import ROWS_PER_TASK, number_rows
from rillwork.sinks.blobs import compress_files, write_blobs, write_gzip_parts
from rillwork.sinks.landing import empty_interval, insert_by_position, reload_interval, swap_interval
from rillwork.sources.files import STAMP, list_files
from rillwork.sources.records import CSV_TEXT, read_csv


def table_to_files(
    df: DataFrame,
    base: str,
    table: str,
    order: Sequence[str],
    batch_size: int = 10_000,
    file_name: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """A table as CSV files of ``batch_size`` rows whose names are made from ``table`` and ``file_num``.

    Exact file names are needed here, so each file is put together in one row; it holds at most
    ``batch_size`` records. Returns the manifest (path, size).
    """
    numbered = number_rows(df, [], order, "_row", rows_per_task=rows_per_task)
    header = F.to_csv(F.struct(*[F.lit(c).alias(c) for c in df.columns]), CSV_TEXT)
    empty = '""' if len(df.columns) == 1 else ""  # a blank line would be skipped
    line = F.to_csv(F.struct(*df.columns), {**CSV_TEXT, "nullValue": empty, "emptyValue": empty})
    number = F.floor((F.col("_row") - 1) / F.lit(batch_size)).cast("long") + F.lit(1)
    lines = numbered.select(number.alias("file_num"), F.struct("_row", line.alias("line")).alias("entry"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("entry")), lambda e: e["line"]), "\n")
    files = lines.groupBy("file_num").agg(body.alias("body")).withColumn("table", F.lit(table))
    name = file_name if file_name is not None else F.format_string("%s_%d.csv", "table", "file_num")
    return write_blobs(files, base, name, F.concat(header, F.lit("\n"), "body", F.lit("\n")))


def files_to_table(spark: SparkSession, files: str | list[str], table: str, multi_line: bool = False) -> None:
    """Append CSV files to a table, columns matched by position. The table's types are used to read.

    Files are split among tasks. Switch ``multi_line`` on for files with line breaks inside quotes, which reads them
    twice.
    """
    insert_by_position(read_csv(spark, files, spark.table(table).schema, multi_line=multi_line), table)


def files_to_tables(spark: SparkSession, base: str, tables: dict[str, str]) -> None:
    """Append each CSV file to the table its name speaks of: ``data_<table>_<time>.csv``."""
    for name, target in tables.items():
        files_to_table(spark, f"{base.rstrip('/')}/data_{name}_{STAMP}*.csv", target)


def table_to_warehouse(
    df: DataFrame,
    table: str,
    landing: str,
    start: str,
    end: str,
    stage: str | None = None,
    loaded_at: Column | None = None,
    part_rows: int = 100_000,
) -> int:
    """Idempotent load of one interval into a landing table; returns the rows loaded.

    With ``stage`` the rows go through gzipped JSON files of ``part_rows`` records, as a warehouse that
    copies from files needs, named ``<table>_part001.json.gz`` and so on, and ``_loaded_from`` is
    the path of the staged file; what was staged there before is replaced, also by nothing. Without it they go
    straight to the landing table, which saves writing and reading them once more.
    """
    if stage is None:
        return reload_interval(df, landing, start, end, F.lit(table), loaded_at)
    spark = df.sparkSession
    stage = stage.rstrip("/")
    write_gzip_parts(df.select(record_text(df).alias("value")), stage, f"{table}_part%03d.json.gz", part_rows)
    if not list_files(spark, stage).limit(1).count():
        empty_interval(spark, landing, start, end)
        return 0
    at = loaded_at if loaded_at is not None else F.current_timestamp()
    rows = spark.read.text(stage).select(
        F.parse_json("value").alias("src"),
        at.cast("timestamp_ntz").alias("_loaded_at"),
        F.concat(F.lit(f"{stage}/"), "_metadata.file_name").alias("_loaded_from"),
        ntz(start).alias("_interval_start"),
        ntz(end).alias("_interval_end"),
    )
    return swap_interval(rows, landing, start, end)


def stage_folder(base: str, table: str, start: str) -> Column:
    """Folder of staged files: quoted table and start date."""
    day = ntz(start).cast("date").cast("string")
    return F.concat(F.lit(base.rstrip("/") + "/"), quote(F.lit(table)), F.lit("/"), day)


def compress_and_copy(
    spark: SparkSession,
    source: str,
    destination: str,
    start: str,
    pattern: str = "**/*",
    compression: str = "gzip",
    target: Column | None = None,
) -> DataFrame:
    """Compress all matching files and write them below the day of the run interval."""
    ending = ".gz" if compression == "gzip" else ".zz"
    day = ntz(start).cast("date").cast("string")
    relative = paths.as_format("path", source, "relative")
    place = target if target is not None else F.concat(day, F.lit("/"), relative, F.lit(ending))
    manifest = compress_files(spark, source, destination, place, pattern, compression)
    return manifest.withColumn("name", paths.name("path"))
