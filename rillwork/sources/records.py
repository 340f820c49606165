"""CSV and JSON files as frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.sources.quoted import read_quoted_csv

# Quotes are doubled inside quoted fields, and spaces belong to the value.
CSV_TEXT = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: str | T.StructType,
    delimiter: str = ",",
    header: bool = True,
    multi_line: bool = False,
    skip_rows: int = 0,
) -> DataFrame:
    """CSV with given types. With ``header=False`` the first line is data, as when names are given.

    ``multi_line`` allows line breaks inside quotes; such files are split among tasks as well (``sources.quoted``), and read
    twice. ``skip_rows`` drops the first lines of every file before the header.
    """
    schema = _schema(schema)
    if multi_line:
        return read_quoted_csv(spark, path, schema, delimiter, header, skip_rows)
    if not skip_rows:
        return spark.read.schema(schema).options(**CSV_TEXT, sep=delimiter, header=header).csv(path)
    lines = without_first_lines(spark, path, skip_rows + int(header))
    options = {**CSV_TEXT, "sep": delimiter}
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return lines.filter("value <> ''").select(F.from_csv("value", fields, options).alias("r")).select("r.*")


def without_first_lines(spark: SparkSession, path: str | list[str], n: int) -> DataFrame:
    """Lines of text files but the first ``n`` of each file.

    Files stay splittable: a task knows from the block offset whether it holds the head of a file, and
    only then counts lines. A head that does not hold ``n`` lines although the file goes on is an error.
    """

    def drop_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        cut: set[str] = set()
        for batch in batches:
            keep = pd.Series(True, index=batch.index)
            heads = batch[batch["start"] == 0]
            for file, lines in heads.groupby("file", sort=False):
                done = seen.get(file, 0)
                keep.loc[lines.index[: max(0, n - done)]] = False
                seen[file] = done + len(lines)
                if lines["block"].iloc[0] < lines["size"].iloc[0]:
                    cut.add(file)
            yield batch.loc[keep, ["value"]]
        for file in cut:
            if seen[file] < n:
                raise ValueError(f"the first block of {file} has fewer than {n} lines")

    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("block"),
        F.col("_metadata.file_size").alias("size"),
    )
    # Only the first block of a file goes through Python.
    heads = lines.filter("start = 0").mapInPandas(drop_heads, "value string")
    return heads.unionByName(lines.filter("start > 0").select("value"))


def read_csv_strings(
    spark: SparkSession,
    path: str | list[str],
    fieldnames: Sequence[str] | None = None,
    delimiter: str = ",",
    multi_line: bool = False,
) -> DataFrame:
    """CSV with every value a string. Short rows are padded with nulls, blank lines skipped, and values
    beyond the header dropped. Without ``fieldnames`` the names come from the header line."""
    reader = spark.read.options(**CSV_TEXT, sep=delimiter, multiLine=multi_line, inferSchema=False)
    if fieldnames is None:
        return reader.option("header", True).csv(path)
    return reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in fieldnames])).csv(path)


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """One JSON value per line."""
    return spark.read.schema(_schema(schema)).json(path)


def parse_json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON text column as typed columns beside the others."""
    parsed = df.withColumn("_parsed", F.from_json(column, schema))
    return parsed.select(*[c for c in df.columns if c != column], "_parsed.*")


def read_json_documents(
    spark: SparkSession, path: str | list[str], schema: str | T.StructType, orient: str = "records"
) -> DataFrame:
    """Files that hold one JSON document each: a list of records, or one object of column lists."""
    schema = _schema(schema)
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    if orient == "records":
        return reader.schema(schema).json(path)
    if orient != "columns":
        raise ValueError(f"orient must be records or columns, found {orient!r}")
    lists = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema.fields])
    names = schema.fieldNames()
    zipped = reader.schema(lists).json(path).select(F.explode(F.arrays_zip(*names)).alias("r"))
    return zipped.select("r.*")
