"""Running aggregates: state per key, kept as a log of changed rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.functions.intervals import interval_tick, next_tick
from rillwork.storage import open_path
from rillwork.streaming.ingest import each_batch


def latest_state(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The last row per key, on a batch or on a stream. A plain aggregate: every task first keeps one
    row per key of its own, so a hot key costs no more than others."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, "_last.*")


#: No interval of a schedule is longer.
LONGEST = {"@hourly": "1 hour", "@daily": "1 day", "@weekly": "7 days", "@monthly": "31 days", "@quarterly": "92 days", "@yearly": "366 days"}


def scheduled_stream(stream: DataFrame, ts: str, schedule: str, *aggregates: Column, delay: str | None = None) -> DataFrame:
    """Aggregate a stream per run interval of a schedule, the intervals that ``operators.intervals.tumbling`` has: weeks
    from Sunday, months, ``rate(45 minutes)`` and so on.

    With ``delay`` the state of old intervals is dropped. Rows that come up to ``delay`` after the end of their interval always
    count; an interval is kept for at most that long and one interval more. The zone of the session must be UTC.
    """
    ends = next_tick(interval_tick(ts, schedule), schedule)
    timed = stream.withColumn("interval_start", interval_tick(ts, schedule)).withColumn("_end", ends.cast("timestamp"))
    if delay:
        length = LONGEST.get(schedule) or re.search(r"\d+\s+\w+", schedule).group()
        timed = timed.withWatermark("_end", f"{delay} {length}")
    grouped = timed.groupBy("_end", "interval_start").agg(*aggregates)
    return grouped.select("interval_start", F.col("_end").cast("timestamp_ntz").alias("interval_end"), *grouped.columns[2:])


def tumbling_stream(stream: DataFrame, ts: str, length: str, *aggregates: Column, delay: str | None = None) -> DataFrame:
    """Aggregate a stream per tumbling interval of a fixed length, counted from the epoch (for weeks and months see
    ``scheduled_stream``). Late rows count, however late they are, and the state of every interval
    is kept on disk. With ``delay`` the state of older intervals is dropped, and rows later than that are not counted any
    more. The zone of the session must be UTC."""
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_at", delay) if delay else timed
    grouped = timed.groupBy(F.window("_at", length)).agg(*aggregates)
    return grouped.select(
        F.col("window.start").cast("timestamp_ntz").alias("interval_start"),
        F.col("window.end").cast("timestamp_ntz").alias("interval_end"),
        *grouped.columns[1:],
    )


def write_changes(df: DataFrame, path: str, checkpoint: str, key: Sequence[str]) -> None:
    """Write the rows each micro-batch changed to a folder named after the batch, then, once per run, a snapshot of the
    newest version of every row up to the last batch."""
    spark, last = df.sparkSession, -1

    def write(batch: DataFrame, batch_id: int) -> None:
        nonlocal last
        batch.write.mode("overwrite").parquet(f"{path}/changes/_batch_id={batch_id}")
        last = max(last, batch_id)

    each_batch(df, write, checkpoint, mode="update")
    if last >= 0:
        read_current(spark, path, df.schema, key).write.mode("overwrite").parquet(f"{path}/snapshots/_upto={last}")


def read_current(spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str]) -> DataFrame:
    """The newest version of every row: the last snapshot, and the changes of the batches after it."""
    snapshots = list_snapshots(f"{path}/snapshots")
    upto = max(snapshots, default=-1)
    log = spark.read.schema(T.StructType([*schema.fields, T.StructField("_batch_id", T.LongType())])).parquet(f"{path}/changes")
    log = log.filter(F.col("_batch_id") > upto)
    if snapshots:
        log = log.unionByName(spark.read.schema(schema).parquet(f"{path}/snapshots/_upto={upto}").withColumn("_batch_id", F.lit(upto).cast("long")))
    values = [c for c in log.columns if c not in (*key, "_batch_id")]
    return latest_state(log, key, ["_batch_id"], values)


def list_snapshots(folder: str) -> list[int]:
    """Numbers of the complete snapshots."""
    system, path = open_path(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
    return [int(f.path.rsplit("/", 2)[1].partition("=")[2]) for f in found if f.path.endswith("/_SUCCESS")]
