"""Files and topics as streams, and the sinks they land in.

Every sink is safe against a micro-batch that runs twice: Spark's file sink commits each batch once, and
the ``foreachBatch`` sinks overwrite a folder named after the batch id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rillwork.sources.files import STAMP
from rillwork.sources.records import CSV_TEXT


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    file_format: str = "parquet",
    pattern: str | None = None,
    files_per_batch: int | None = None,
    **options: Any,
) -> DataFrame:
    """Files of a folder as they arrive, each of them once."""
    reader = spark.readStream.format(file_format).schema(schema).options(**options)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(writer: Any) -> None:
    """Process what is there and stop; a later run goes on from the checkpoint."""
    query: StreamingQuery = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), file_format: str = "parquet") -> None:
    """Append a stream to a table of files."""
    writer = stream.writeStream.format(file_format).outputMode("append").partitionBy(*partition_by)
    run_available(writer.option("checkpointLocation", checkpoint).option("path", path))


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a write per micro-batch. ``write`` gets the batch id and must overwrite what an earlier try
    of the same batch wrote."""
    run_available(stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint))


def ingest_csv_tables(
    spark: SparkSession,
    base: str,
    targets: dict[str, str],
    schemas: dict[str, T.StructType],
    checkpoint: str,
) -> None:
    """Poll a folder of ``data_<table>_<time>.csv`` files and append each to the table of its name; every
    file is loaded once. One stream per table, as tables differ in their columns."""
    for name, target in targets.items():
        files = stream_files(spark, base, schemas[name], "csv", f"data_{name}_{STAMP}*.csv", **CSV_TEXT, header=True)
        ingest(files, target, f"{checkpoint}/{name}")


def route_stream(stream: DataFrame, path: str, checkpoint: str, kinds: Sequence[str], type_column: str) -> None:
    """Each message type in a folder of its own, from one pass over the stream; other types vanish."""
    routed = stream.filter(F.col(type_column).isin(*kinds)).withColumn("route", F.col(type_column))
    ingest(routed, path, checkpoint, partition_by=["route"])


def topic_source(
    spark: SparkSession,
    file_format: str = "kafka",
    servers: str | None = None,
    topic: str | None = None,
    group: str | None = None,
    schema: str | None = None,
    path: str | None = None,
    **options: Any,
) -> DataFrame:
    """Messages of a topic as (key, value). The format is an argument, so that a folder of key/value
    files can stand in for a broker."""
    if servers:
        options["kafka.bootstrap.servers"] = servers
    if topic:
        options["subscribe"] = topic
    if group:
        options["kafka.group.id"] = group
    reader = spark.readStream.format(file_format).options(**options)
    if schema:
        reader = reader.schema(schema)
    return (reader.load(path) if path else reader.load()).select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
    )


def topic_options(
    servers: str, topic: str, client: str | None = None, compression: str | None = None, batch_size: int | None = None
) -> dict[str, str]:
    """Options of a topic sink."""
    wanted = {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.client.id": client,
        "kafka.compression.type": compression,
        "kafka.batch.size": batch_size,
    }
    return {k: str(v) for k, v in wanted.items() if v is not None}


def topic_sink(
    stream: DataFrame, key: Column, value: Column, checkpoint: str, file_format: str = "kafka", **options: Any
) -> None:
    """Send rows as (key, value) messages."""
    messages = stream.select(key.cast("string").alias("key"), value.cast("string").alias("value"))
    run_available(messages.writeStream.format(file_format).options(**options).option("checkpointLocation", checkpoint))
