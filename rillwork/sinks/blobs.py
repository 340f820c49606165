"""Opaque files: one file per row, copies, and compressed copies.

The writes run inside the tasks. Each function runs its job once and returns the manifest it wrote, so
reading the manifest twice does not write the files twice.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork import storage
from rillwork.functions import paths
from rillwork.session import settle, small_batches
from rillwork.sources.files import matching

#: Bytes of an Arrow batch of whole files, about: Spark's default of 64 MB is held several times by each Python worker.
BATCH = 4 << 20


def write_blobs(
    df: DataFrame,
    base: str,
    path: Column | str,
    data: Column | str,
    codec: str | None = None,
    append: bool = False,
    metadata: Column | None = None,
    path_format: str = "relative",
) -> DataFrame:
    """One file per row at ``base/path``; text is written as UTF-8, folders are created.

    Returns path, bytes written and metadata; two rows for one path are an error. ``append`` adds to an existing file; it needs one row per
    path and is not safe against a task that runs twice, overwriting is.
    """
    path = F.col(path) if isinstance(path, str) else path
    data = F.col(data) if isinstance(data, str) else data
    rows = df.select(
        F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(path, F.lit("/"))).alias("path"),
        data.cast("binary").alias("data"),
        (metadata if metadata is not None else F.lit(None)).cast("string").alias("metadata"),
    )

    if not append:
        _refuse_repeats(rows, F.col("path"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for target, content in zip(batch.column(0), batch.column(1)):
                # A view of the batch: no file is copied.
                chunks = [memoryview(content.as_buffer())] if content.is_valid else []
                packed = storage.deflated(chunks, codec) if codec else chunks
                sizes.append(storage.write_chunks(target.as_py(), packed, append))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(2)], names=["path", "size", "metadata"])

    with small_batches(df.sparkSession, BATCH):
        written = settle(rows.mapInArrow(write, "path string, size long, metadata string"), "manifest")
    return written.withColumn("path", paths.as_format("path", base, path_format))


def write_lines(rows: DataFrame, base: str, codec: str | None = None, heads: str = "", clear: bool = False) -> DataFrame:
    """Text files named in ``name`` with the lines of ``value`` in the order of ``_id``; returns the manifest of the files
    written (path below ``base``, rows, bytes).

    One task writes a file, as one name is one file; batch by batch, so that no file is held in memory. ``heads`` is the
    first line of each file. ``clear`` deletes what else the folder holds, once all files are whole.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file, count, packer = None, None, 0, None

        def add(text: str) -> None:
            file.write(packer.compress(text.encode()) if packer else text.encode())

        def close() -> pd.DataFrame:
            if packer:
                file.write(packer.flush())
            return pd.DataFrame({"path": [name], "n_rows": [count], "size": [file.close()]})

        for batch in batches:
            for own, lines in batch.groupby("name", sort=True)["value"]:
                if own != name:
                    if name is not None:
                        yield close()
                    name, file, count = own, storage.PartFile(f"{base.rstrip('/')}/{own}"), 0
                    packer = zlib.compressobj(wbits=storage.WINDOW_BITS[codec]) if codec else None
                    if heads:
                        add(heads + "\n")
                add("".join(f"{x}\n" for x in lines))
                count += len(lines)
        if name is not None:
            yield close()

    ordered = rows.select("name", "_id", "value").repartition(parts, "name").sortWithinPartitions("name", "_id")
    before = _names_below(base) if clear else []
    manifest = settle(ordered.mapInPandas(write, "path string, n_rows long, size long"), "manifest")
    _delete_others(before, manifest, base)
    return manifest


def write_gzip_parts(lines: DataFrame, base: str, name: str, part_rows: int) -> DataFrame:
    """Text files of up to ``part_rows`` lines, packed with gzip and numbered in the order of the rows, in place of what
    the folder held; returns the manifest (path below ``base``, bytes). ``name`` is a format for the number.

    Spark's own writer makes the files beside the folder, without a shuffle; tasks then give them their names. Only
    the list of files is numbered in one task. A frame without rows has no files.
    """
    spark = lines.sparkSession
    base = base.rstrip("/")
    above, _, own = base.rpartition("/")
    raw = f"{above}/_{own}-{uuid.uuid4().hex}"
    lines.write.option("maxRecordsPerFile", part_rows).option("compression", "gzip").text(raw)
    found = spark.read.format("binaryFile").load(raw).select("path", F.col("length").alias("size"))
    task, part = (F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)[^/]*$", k).cast("long") for k in (1, 2))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(task, part))
    # A task without rows may leave a file: 20 bytes of gzip that hold nothing.
    named = found.filter(F.col("size") > 20).select(F.col("path").alias("source"), F.format_string(name, number).alias("path"), "size")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, path in zip(batch["source"], batch["path"]):
                storage.move(source, f"{base}/{path}")
            yield batch[["path", "size"]]

    before = _names_below(base)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = settle(named, "parts").repartition(parts, "source")
    manifest = settle(listed.mapInPandas(place, "path string, size long"), "manifest")
    _delete_others(before, manifest, base)
    system, path = storage.open_path(raw)
    system.delete_dir(path)
    return manifest


def _delete_others(before: list[str], manifest: DataFrame, base: str) -> None:
    """Of the files ``before``, delete those that the manifest does not name."""
    if before:
        old = manifest.sparkSession.createDataFrame([(n,) for n in before], "path string")
        system, path = storage.open_path(base)
        for row in old.join(manifest, "path", "left_anti").collect():
            system.delete_file(f"{path.rstrip('/')}/{row.path}")


def _names_below(base: str) -> list[str]:
    """Files of a folder, by their paths below it."""
    system, path = storage.open_path(base)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return [f.path[len(path.rstrip("/")) + 1 :] for f in found if f.type == fs.FileType.File]


def write_gzip_lines(rows: DataFrame, base: str) -> DataFrame:
    """``write_lines`` with gzip, in place of what the folder held."""
    return write_lines(rows, base, "gzip", clear=True)


def _refuse_repeats(listing: DataFrame, target: Column) -> None:
    """Two files must not be written to one path."""
    twice = listing.groupBy(target.alias("path")).agg(F.count("*").alias("n")).filter("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"several files would be written to {', '.join(r.path for r in twice)}")


def _copy(listing: DataFrame, target: Column, transform: Callable | None, codec: str | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for source, dest in zip(batch["source"], batch["path"]):
                chunks = storage.read_chunks(source)
                sizes.append(storage.write_chunks(dest, transform(chunks, codec) if transform else chunks))
            yield pd.DataFrame({"source": batch["source"], "path": batch["path"], "size": sizes})

    _refuse_repeats(listing, target)
    named = listing.select(F.col("path").alias("source"), target.alias("path"))
    return settle(named.mapInPandas(run, "source string, path string, size long"), "manifest")


def copy_files(spark: SparkSession, source: str, destination: str, pattern: str = "**/*") -> DataFrame:
    """Copy a folder tree. Only paths travel through Spark; each task streams its files chunk by chunk,
    so a file may be larger than a task's memory."""
    listing = matching(spark, source, pattern).select("path")
    target = F.concat(F.lit(destination.rstrip("/") + "/"), paths.as_format("path", source, "relative"))
    return _copy(listing, target, None, None)


def compress_files(
    spark: SparkSession,
    source: str,
    destination: str,
    target: Column,
    pattern: str = "**/*",
    codec: str = "gzip",
) -> DataFrame:
    """Compress every matching file to a path made from its ``name`` and ``path`` columns. Any codec
    but 'gzip' means zlib."""
    codec = "gzip" if codec == "gzip" else "zlib"
    listing = matching(spark, source, pattern).select("path").withColumn("name", paths.name("path"))
    placed = listing.withColumn("_target", F.concat(F.lit(destination.rstrip("/") + "/"), target))
    return _copy(placed, F.col("_target"), storage.deflated, codec)


def decompress_files(
    spark: SparkSession,
    source: str,
    destination: str,
    target: Column,
    pattern: str = "**/*",
    codec: str = "gzip",
) -> DataFrame:
    """The reverse of ``compress_files``."""
    codec = "gzip" if codec == "gzip" else "zlib"
    listing = matching(spark, source, pattern).select("path").withColumn("name", paths.name("path"))
    placed = listing.withColumn("_target", F.concat(F.lit(destination.rstrip("/") + "/"), target))
    return _copy(placed, F.col("_target"), storage.inflated, codec)
