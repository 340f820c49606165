"""Large text files as gzip of independent members with an index.

Any gzip tool reads such a file: members one after the other are a valid file. With the index of its members it is also
written and read by many tasks. A member holds whole lines of a stretch of the source.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork import storage
from rillwork.functions import paths
from rillwork.sinks.append import append_made, fold_appends
from rillwork.sources.files import matching

#: Bytes of the source in a member, about.
MEMBER = 4 << 20
INDEX = "path string, at bigint, start bigint, length bigint"


def line_start(source: str, place: int, size: int) -> int:
    """Where the first line begins that starts at ``place`` or after it."""
    if place <= 0 or place >= size:
        return max(0, min(place, size))
    at = place - 1
    for chunk in storage.read_range(source, at, size - at):
        found = chunk.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(chunk)
    return size


def member(row: Any) -> Iterator[bytes]:
    """The lines that begin in a stretch, as a gzip file of their own; nothing if none does."""
    begin, end = line_start(row.source, row.begin, row.size), line_start(row.source, row.end, row.size)
    if begin < end:
        yield from storage.deflated(storage.read_range(row.source, begin, end - begin), "gzip")


def compress_in_members(spark: SparkSession, source: str, destination: str, pattern: str = "**/*", size: int = MEMBER) -> DataFrame:
    """Every matching text file as ``destination/<its path>.gz``, its stretches of ``size`` bytes compressed by many
    tasks. Returns the written index: path, at, start, length of each member. A new run takes the place of the last one."""
    listing = matching(spark, source, pattern).select("path", F.col("length").alias("size"))
    name = F.concat(paths.as_format("path", source, "relative"), F.lit(".gz"))
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("long"))
    stretches = listing.select(name.alias("target"), F.col("path").alias("source"), "size", F.posexplode(begins).alias("at", "begin"))
    stretches = stretches.select(F.col("target").alias("path"), F.col("at").cast("long").alias("at"), "source", "begin", F.least(F.col("begin") + size, "size").alias("end"), "size")
    # Stretches of one file go to many tasks.
    pieces = append_made(stretches.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "at"), destination, 0, member)
    fold_appends(spark, destination)
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select("path", "at", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("start"), "length")
    index = f"{destination.rstrip('/')}/_index"
    placed.filter("length > 0").write.mode("overwrite").parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def read_in_members(spark: SparkSession, destination: str) -> DataFrame:
    """path, at (the member), line_num in it, value: the lines of all files that ``compress_in_members`` wrote there, members
    dealt to tasks by their place."""
    root = destination.rstrip("/")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                opener, rest, count = zlib.decompressobj(wbits=storage.WINDOW_BITS["gzip"]), b"", 0
                for chunk in storage.read_range(f"{root}/{row.path}", row.start, row.length):
                    *lines, rest = (rest + opener.decompress(chunk)).split(b"\n")
                    if lines:
                        yield pd.DataFrame({"path": row.path, "at": row.at, "line_num": range(count, count + len(lines)), "value": [x.decode() for x in lines]})
                        count += len(lines)
                if rest:
                    yield pd.DataFrame({"path": [row.path], "at": [row.at], "line_num": [count], "value": [rest.decode()]})

    index = spark.read.schema(INDEX).parquet(f"{root}/_index")
    dealt = index.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "at")
    return dealt.mapInPandas(read, "path string, at bigint, line_num bigint, value string")
