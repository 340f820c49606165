"""Appending to files, safe against tasks and jobs that run twice.

An append never touches a file that is there. Its tasks write segments, each attempt under a name of its own, and say what stands
where; Spark keeps what the attempt says that it accepts. These rows are the append's manifest, and only with it is the append
seen: segments of killed or repeated attempts are in no manifest. An append has a number of the caller's; one that is
made again under its number takes the place of the first.

The content of a file is the pieces of all appends, by their numbers and within one by the order of the rows.
``fold_appends`` writes them out as plain files, whatever was folded before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork import storage
from rillwork.session import settle

PIECES = "path string, at bigint, segment string, start bigint, length bigint"


def append_blobs(df: DataFrame, base: str, path: Column | str, data: Column | str, order: Column | str, number: int) -> DataFrame:
    """Append the data of each row to the file ``base/path``, in the order of a whole number that is unique per path. Returns the
    manifest: path, at, segment, start, length. Null data adds nothing; text is written as UTF-8."""
    path, data, order = (F.col(c) if isinstance(c, str) else c for c in (path, data, order))
    rows = df.select(F.ltrim(path, F.lit("/")).alias("path"), order.cast("long").alias("at"), data.cast("binary").alias("data")).filter("data IS NOT NULL")
    return append_made(rows, base, number, lambda row: [bytes(row.data)])


def append_made(pieces: DataFrame, base: str, number: int, make: Callable[[Any], Iterable[bytes]]) -> DataFrame:
    """``append_blobs`` for pieces (path, at, other columns) whose bytes ``make`` gives from a row, inside the task."""
    spark, folder = pieces.sparkSession, f"{base.rstrip('/')}/_segments/{number}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, name = None, f"{uuid.uuid4().hex}.seg"
        for batch in batches:
            starts, lengths = [], []
            for row in batch.itertuples(index=False):
                file = file or storage.PartFile(f"{folder}/{name}")
                starts.append(file.size)
                for chunk in make(row):
                    file.write(chunk)
                lengths.append(file.size - starts[-1])
            yield pd.DataFrame({"path": batch["path"], "at": batch["at"], "segment": name, "start": starts, "length": lengths})
        if file:
            file.close()

    manifest = f"{base.rstrip('/')}/_appends/number={number}"
    pieces.mapInPandas(write, PIECES).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(PIECES).parquet(manifest)


def committed(base: str) -> list[int]:
    """Numbers of the appends whose manifest is whole."""
    from pyarrow import fs

    system, path = storage.open_path(f"{base.rstrip('/')}/_appends")
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(int(f.path.rsplit("/", 2)[1].partition("=")[2]) for f in found if f.path.endswith("/_SUCCESS"))


def read_pieces(spark: SparkSession, base: str) -> DataFrame:
    """number, path, at, segment, start, length of all pieces of the appends that are seen."""
    numbers = committed(base)
    folders = [f"{base.rstrip('/')}/_appends/number={n}" for n in numbers]
    if not folders:
        return spark.createDataFrame([], f"number bigint, {PIECES}")
    read = spark.read.schema(f"{PIECES}, number bigint").option("basePath", f"{base.rstrip('/')}/_appends").parquet(*folders)
    return read.select("number", "path", "at", "segment", "start", "length")


def fold_appends(spark: SparkSession, base: str) -> DataFrame:
    """Write every file with the pieces of all appends; returns the manifest (path, size). A file is written by one task that
    streams its pieces, so that it may be larger than the task's memory; it appears when it is whole, and folding again
    writes the same bytes."""
    root, parts = base.rstrip("/"), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, file = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.path != path:
                    if file:
                        yield pd.DataFrame({"path": [path], "size": [file.close()]})
                    path, file = row.path, storage.PartFile(f"{root}/{row.path}")
                for chunk in storage.read_range(f"{root}/_segments/{row.number}/{row.segment}", row.start, row.length):
                    file.write(chunk)
        if file:
            yield pd.DataFrame({"path": [path], "size": [file.close()]})

    ordered = read_pieces(spark, base).repartition(parts, "path").sortWithinPartitions("path", "number", "at")
    return settle(ordered.mapInPandas(write, "path string, size bigint"), "folded")


def sweep_segments(spark: SparkSession, base: str) -> int:
    """Delete the segments that no manifest names, when no append is running. Returns their number."""
    from pyarrow import fs

    system, path = storage.open_path(f"{base.rstrip('/')}/_segments")
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    names = [(f.path, f.path.rsplit("/", 1)[1]) for f in found if f.type == fs.FileType.File]
    if not names:
        return 0
    known = read_pieces(spark, base).select("segment").distinct()
    loose = spark.createDataFrame(names, "place string, segment string").join(known, "segment", "left_anti").collect()
    for row in loose:
        system.delete_file(row.place)
    return len(loose)
