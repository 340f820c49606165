"""Frames as CSV, JSON and partitioned files."""

from __future__ import annotations

from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions.json_values import record_text, safe_columns
from rillwork.operators.batches import ROWS_PER_TASK, chunk_rows
from rillwork.session import settle
from rillwork.sinks.blobs import write_lines
from rillwork.sources.files import list_files
from rillwork.sources.records import CSV_TEXT
from rillwork.storage import open_path


def write_json_records(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """One JSON object per line; nulls kept, Decimal as number, bytes as hex, times as ISO text."""
    writer = safe_columns(df).write.mode(mode).option("ignoreNullFields", "false")
    writer.option("compression", compression).json(path)


def write_csv(
    df: DataFrame,
    path: str,
    quote_all: bool = True,
    delimiter: str = ",",
    header: bool = True,
    mode: str = "errorifexists",
    compression: str = "none",
) -> None:
    """CSV in one of two dialects: every field quoted, or quotes only where needed. Null is empty, and ``""`` where it
    would leave a blank line, which readers skip. A frame without rows has no lines, not even a header."""
    options = {**CSV_TEXT, "sep": delimiter, "header": header and not df.isEmpty(), "quoteAll": quote_all, "compression": compression}
    empty = '""' if len(df.columns) == 1 and not quote_all else ""
    df.write.mode(mode).options(**options, nullValue=empty, emptyValue=empty).csv(path)


def write_by_template(
    df: DataFrame,
    base: str,
    keys: Sequence[str],
    file_format: str = "parquet",
    append: bool = False,
    path_format: str = "relative",
    **options: str,
) -> DataFrame:
    """One folder per combination of key values, ``base/key=value/...``; returns the files of this write.

    Without ``append`` only the folders that get rows are replaced. The rebalance hint brings the rows
    of a key together so that a folder gets few files, and lets AQE split a key that is too large for
    one task.
    """
    spark = df.sparkSession
    before = settle(list_files(spark, base, "**/part-*", path_format=path_format).select("path"), "before") if _exists(base) else None
    writer = df.hint("rebalance", *keys).write.partitionBy(*keys).format(file_format).options(**options)
    if append:
        writer.mode("append").save(base)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(base)
    after = list_files(spark, base, "**/part-*", path_format=path_format)
    # Names of earlier writes do not come again.
    return after if before is None else after.join(before, "path", "left_anti")


def _exists(base: str) -> bool:
    system, path = open_path(base)
    return system.get_file_info(path).type == fs.FileType.Directory


def write_to_paths(df: DataFrame, base: str, path: Column, order: Sequence[str], file_format: str = "json", columns: Sequence[str] | None = None) -> DataFrame:
    """Rows as JSON lines or CSV in files whose whole path below ``base`` is made from each row; rows of one path are one
    file, in the given order. Returns the manifest of the files written (path, n_rows, size).

    One file is written by one task. Where a path gets more rows than that, make its parts explicit with ``chunk_rows``
    and name the part in the path.
    """
    names = list(columns or df.columns)
    kept = df.select(*names)
    if file_format == "json":
        value, heads = record_text(kept), ""
    else:
        value = F.to_csv(F.struct(*names), {**CSV_TEXT, "nullValue": "", "emptyValue": ""})
        heads = ",".join(names)
    rows = df.select(path.alias("name"), F.struct(*order).alias("_id"), value.alias("value"))
    return write_lines(rows, base, heads=heads)


def write_chunks_csv(
    df: DataFrame,
    base: str,
    size: int,
    order: Sequence[str],
    group: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> None:
    """CSV files of at most ``size`` rows with the running file number in the path."""
    chunked = chunk_rows(df, size, group, order, "file_num", rows_per_task)
    gathered = chunked.repartition(*group, "file_num").sortWithinPartitions(*group, "file_num", *order)
    writer = gathered.write.partitionBy(*group, "file_num")
    writer.options(**CSV_TEXT, header=True, nullValue="", emptyValue="").csv(base)
