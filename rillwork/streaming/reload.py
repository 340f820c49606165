"""Streams landed by run interval, and the compaction of what their batches leave.

A micro-batch writes one folder per interval it touches, named after its run (a checkpoint) and the batch, and then a
list of the origins of its rows, as a rule their files. Only batches with such a list are seen. Of the rows of one origin
those of the newest run count: a run with a new checkpoint that reads a file again takes the place of that file's earlier rows, however
it cuts its batches, and a run that sees late files alone adds them to their intervals.

Compaction gathers the folders of an interval into one. What stands for what is told by one small file that is replaced
as a whole, so a reader sees the state before or after; only then are the gathered folders deleted.
"""

from __future__ import annotations

import json
import time
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork import storage
from rillwork.functions.intervals import truncate
from rillwork.session import settle
from rillwork.streaming.ingest import each_batch

PLACES = ["_interval_start", "_run", "_batch_id"]
FOLDER = "_interval_start timestamp_ntz, _run bigint, _batch_id bigint"


def run_number(checkpoint: str) -> int:
    """When the job of a checkpoint first ran, in microseconds; kept beside the checkpoint."""
    system, path = storage.open_path(f"{checkpoint.rstrip('/')}-run")
    if system.get_file_info(path).type == fs.FileType.NotFound:
        storage.write_chunks(f"{checkpoint.rstrip('/')}-run", [str(time.time_ns() // 1000).encode()])
    return int(b"".join(storage.read_chunks(f"{checkpoint.rstrip('/')}-run")))


def reload_from_stream(stream: DataFrame, path: str, checkpoint: str, ts: str, unit: str = "day", origin: Column | None = None) -> None:
    """Land a stream by run interval. Late rows re-open their interval, under the same checkpoint or a new one.

    ``origin`` tells which rows a later run may take the place of; the default is the file a row comes from, which a
    stream over files knows. The rebalance hint gathers the rows of an interval into few files and splits an interval
    that is too large for one task.
    """
    run = run_number(checkpoint)
    source = F.col("_metadata.file_path") if origin is None else origin
    marked = stream.withColumn("_origin", F.xxhash64(source))

    def write(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumns({"_from_run": F.lit(run), "_interval_start": truncate(ts, unit), "_run": F.lit(run), "_batch_id": F.lit(batch_id)})
        writer = placed.hint("rebalance", "_interval_start").write.partitionBy(*PLACES)
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/rows")
        # From here on the batch is seen.
        batch.select("_origin").distinct().write.mode("overwrite").parquet(f"{path}/origins/_run={run}/_batch_id={batch_id}")

    each_batch(marked, write, checkpoint)


def pointer(path: str) -> dict:
    """The gathered folders that are seen, those that they stand for, and the number of the last compaction."""
    system, place = storage.open_path(f"{path}/current.json")
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return {"generation": 0, "merged": [], "gone": []}
    return json.loads(b"".join(storage.read_chunks(f"{path}/current.json")))


def folders(spark: SparkSession, listed: list) -> DataFrame:
    """Named folders as a frame: as many rows as one compaction gathers."""
    return spark.createDataFrame([tuple(x) for x in listed], "i string, r long, b long").select(
        F.col("i").cast("timestamp_ntz").alias("_interval_start"), F.col("r").alias("_run"), F.col("b").alias("_batch_id")
    )


def visible(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that are seen, with their places, origin and run."""
    state, own = pointer(path), T.StructType([*schema.fields, T.StructField("_origin", T.LongType()), T.StructField("_from_run", T.LongType())])
    for field in T.StructType.fromDDL(FOLDER).fields:
        own = own.add(field)
    rows = spark.read.schema(own).parquet(f"{path}/rows")
    origins = spark.read.schema("_origin bigint, _run bigint, _batch_id bigint").parquet(f"{path}/origins")
    written = rows.filter("_run >= 0").join(origins.select("_run", "_batch_id").distinct(), ["_run", "_batch_id"], "left_semi").select(*own.names)
    if state["gone"]:
        same = [F.col("_interval_start").eqNullSafe(F.col("i")), F.col("_run") == F.col("r"), F.col("_batch_id") == F.col("b")]
        written = written.join(folders(spark, state["gone"]).toDF("i", "r", "b"), same, "left_anti")
    if state["merged"]:
        merged = folders(spark, state["merged"]).toDF("i", "r", "b")
        same = [F.col("_interval_start").eqNullSafe(F.col("i")), F.col("_run") == F.col("r"), F.col("_batch_id") == F.col("b")]
        written = written.unionByName(rows.filter("_run < 0").join(merged, same, "left_semi"))
    # Origins that were read again: as a rule none or few.
    runs = origins.groupBy("_origin", "_run").agg(F.lit(1).alias("one"))
    newest = runs.groupBy("_origin").agg(F.max("_run").alias("_newest"))
    old = runs.join(newest, "_origin").filter("_run < _newest").select("_origin", F.col("_run").alias("_from_run"))
    return written.join(old, ["_origin", "_from_run"], "left_anti").select(*own.names)


def read_reloaded(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows landed by ``reload_from_stream`` with their _interval_start."""
    return visible(spark, path, schema).select(*schema.fieldNames(), "_interval_start")


def compact_reloaded(spark: SparkSession, path: str, schema: T.StructType) -> int:
    """Gather every interval that lies in several folders into one, and delete these. Returns the number of such intervals.

    Rows of runs that newer ones have taken the place of are not kept. One compaction may run at a time; batches may land
    meanwhile, as what they write is not among the folders that are gathered.
    """
    state = pointer(path)
    sweep(path, state)
    seen = visible(spark, path, schema)
    at = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1)
    rows = spark.read.schema(T.StructType([*schema.fields, *T.StructType.fromDDL(FOLDER).fields])).parquet(f"{path}/rows")
    # All folders but those of batches that are still being written; also the ones that newer runs have emptied.
    done = spark.read.schema("_run bigint, _batch_id bigint").parquet(f"{path}/origins").distinct()
    listed = rows.select(*PLACES, at.alias("folder")).distinct()
    listed = listed.filter("_run < 0").unionByName(listed.join(done, ["_run", "_batch_id"], "left_semi").select(*listed.columns))
    many = listed.groupBy("_interval_start").agg(F.collect_list(F.struct("_run", "_batch_id", "folder")).alias("of")).filter("size(of) > 1")
    due = many.select(F.col("_interval_start").cast("string").alias("name"), "of").collect()  # names of folders only
    if not due:
        return 0
    generation = state["generation"] + 1
    names = {r.name for r in due}
    wanted = settle(spark.createDataFrame([(n,) for n in names], "name string").select(F.col("name").cast("timestamp_ntz").alias("_interval_start")), "due")
    gathered = seen.join(wanted, "_interval_start", "left_semi").withColumns({"_run": F.lit(-generation).cast("long"), "_batch_id": F.lit(0).cast("long")})
    gathered = gathered.select(*schema.fieldNames(), "_origin", "_from_run", *PLACES)
    writer = gathered.hint("rebalance", "_interval_start").write.partitionBy(*PLACES)
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/rows")
    merged = [m for m in state["merged"] if m[0] not in names] + [[n, -generation, 0] for n in names]
    gone = [[r.name, f["_run"], f["_batch_id"], unquote(f["folder"])] for r in due for f in r.of]
    state = {"generation": generation, "merged": merged, "gone": [g[:3] for g in gone], "folders": [g[3] for g in gone]}
    storage.write_chunks(f"{path}/current.json", [json.dumps(state).encode()])
    sweep(path, state)
    return len(due)


def sweep(path: str, state: dict) -> None:
    """Delete the folders that a gathered one stands for."""
    for folder in state.get("folders", ()):
        system, place = storage.open_path(folder)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)
    if state.get("folders"):
        storage.write_chunks(f"{path}/current.json", [json.dumps({**state, "gone": [], "folders": []}).encode()])
