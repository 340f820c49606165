"""User functions that emit batches, over files of the given tables."""

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import functions as F

from rillwork.session import fresh_dir
from rillwork.sources.emitted import allows, register_emitter
from rillwork.storage import open_path
from rillwork.streaming.ingest import ingest
from rillwork.suite.registry import query, table

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def _daily_files(spark, events, base):
    events.withColumn("day", F.to_date("ts")).repartition("day").write.mode("append").partitionBy("day").parquet(base)


def _register(spark, name, base):
    """A function whose units are the files, by day, and that emits their rows in batches of 500."""

    def units(conditions):
        system, place = open_path(base)
        files = system.get_file_info(fs.FileSelector(place, recursive=True))
        names = sorted(f.path[len(place) :] for f in files if f.path.endswith(".parquet"))
        days = {n: n.partition("day=")[2][:10] for n in names}
        return [n for n in names if allows([(s, str(v)[:10] if s != ">" else str(v)) for s, v in conditions.get("ts", ())], days[n], days[n] + " 99")]

    def emit(unit):
        system, place = open_path(base)
        with system.open_input_file(f"{place}{unit}") as file:
            yield from pq.ParquetFile(file).iter_batches(500, columns=["event_id", "ts", "user_id", "event_type", "value"])

    register_emitter(spark, name, SCHEMA, units, emit)


@query("source_function", "SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND value > 5")
def source_function(spark, sf):
    """A function that emits the events of each day's files; the condition on the time spares it the earlier days."""
    base = fresh_dir(spark, "daily")
    _daily_files(spark, table(spark, sf, "events"), base)
    _register(spark, "events_by_day", base)
    rows = spark.read.format("events_by_day").load()
    return rows.filter((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("value") > 5))


@query("stream_source_function", "SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_source_function(spark, sf):
    """The same function as a stream: the first half of the days, then, after a restart, the rest."""
    base, target, checkpoint = fresh_dir(spark, "daily"), fresh_dir(spark, "emitted"), fresh_dir(spark, "checkpoint")
    events = table(spark, sf, "events")
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (events.filter(early), events.filter(~early)):
        _daily_files(spark, part, base)
        _register(spark, "events_by_day", base)
        ingest(spark.readStream.format("events_by_day").load(), target, checkpoint)
    return spark.read.schema(SCHEMA).parquet(target)
