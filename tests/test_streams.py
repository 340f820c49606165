from datetime import datetime

from pyspark.sql import functions as F

from rillwork.streaming import ingest, reload, state
from tests.conftest import rows

SCHEMA = "id long, ts timestamp_ntz, kind string"


def arrive(spark, folder, *items):
    spark.createDataFrame([(i, datetime(2024, 1, d), k) for i, d, k in items], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_each_file_once_across_restarts(spark, folder):
    source, target, checkpoint = (f"{folder}/{n}" for n in ("in", "out", "check"))
    arrive(spark, source, (1, 1, "a"))
    for _ in range(2):
        ingest.ingest(ingest.stream_files(spark, source, SCHEMA), target, checkpoint)
    arrive(spark, source, (2, 1, "a"))
    ingest.ingest(ingest.stream_files(spark, source, SCHEMA), target, checkpoint)
    assert rows(spark.read.parquet(target), "id") == [(1,), (2,)]


def test_late_rows_reopen_their_interval(spark, folder):
    source, target, checkpoint = (f"{folder}/{n}" for n in ("in", "out", "check"))
    for items in ([(1, 1, "a"), (2, 2, "a")], [(3, 3, "a")], [(4, 1, "late")]):
        arrive(spark, source, *items)
        stream = ingest.stream_files(spark, source, SCHEMA)
        reload.reload_from_stream(stream, target, checkpoint, "ts")
    got = reload.read_reloaded(spark, target, spark.read.parquet(source).schema)
    assert rows(got, "_interval_start", "id") == [
        (datetime(2024, 1, 1), 1), (datetime(2024, 1, 1), 4), (datetime(2024, 1, 2), 2), (datetime(2024, 1, 3), 3),
    ]


def test_replayed_batch_is_not_doubled(spark, folder):
    source, target = f"{folder}/in", f"{folder}/out"
    arrive(spark, source, (1, 1, "a"), (2, 2, "a"))
    for run in range(2):  # a new checkpoint: batch 0 comes again
        stream = ingest.stream_files(spark, source, SCHEMA)
        reload.reload_from_stream(stream, target, f"{folder}/check{run}", "ts")
    assert reload.read_reloaded(spark, target, spark.read.parquet(source).schema).count() == 2


def test_new_run_with_other_batches_takes_the_place_of_the_old(spark, folder):
    source, target = f"{folder}/in", f"{folder}/out"
    for i in range(4):
        arrive(spark, source, (i, 1, "a"), (10 + i, 2, "b"))
    for run, per_batch in enumerate((1, 3)):
        stream = ingest.stream_files(spark, source, SCHEMA, files_per_batch=per_batch)
        reload.reload_from_stream(stream, target, f"{folder}/check{run}", "ts")
    got = reload.read_reloaded(spark, target, spark.read.parquet(source).schema)
    assert rows(got, "id") == [(i,) for i in (0, 1, 2, 3, 10, 11, 12, 13)]


def test_state_is_the_last_row_per_key(spark, folder):
    source, target, checkpoint = (f"{folder}/{n}" for n in ("in", "out", "check"))
    schema = None
    for items in ([(1, 1, "a"), (2, 5, "b")], [(3, 3, "a")], [(4, 2, "a")]):
        arrive(spark, source, *items)
        latest = state.latest_state(ingest.stream_files(spark, source, SCHEMA), ["kind"], ["ts", "id"], ["id", "ts"])
        state.write_changes(latest, target, checkpoint, ["kind"])
        schema = latest.schema
    assert rows(state.read_current(spark, target, schema, ["kind"]), "kind", "id") == [("a", 3), ("b", 2)]


def test_window_counts_grow(spark, folder):
    source, target, checkpoint = (f"{folder}/{n}" for n in ("in", "out", "check"))
    schema = None
    for items in ([(1, 1, "a"), (2, 2, "a")], [(3, 1, "a")]):
        arrive(spark, source, *items)
        daily = state.tumbling_stream(ingest.stream_files(spark, source, SCHEMA), "ts", "1 day", F.count("*").alias("n"))
        state.write_changes(daily, target, checkpoint, ["interval_start", "interval_end"])
        schema = daily.schema
    got = state.read_current(spark, target, schema, ["interval_start", "interval_end"])
    assert rows(got, "interval_start", "n") == [(datetime(2024, 1, 1), 2), (datetime(2024, 1, 2), 1)]


def test_routes_are_folders(spark, folder):
    source, target = f"{folder}/in", f"{folder}/out"
    arrive(spark, source, (1, 1, "SCHEMA"), (2, 1, "RECORD"), (3, 1, "OTHER"))
    ingest.route_stream(ingest.stream_files(spark, source, SCHEMA), target, f"{folder}/check", ["SCHEMA", "RECORD"], "kind")
    assert rows(spark.read.parquet(target), "route", "id") == [("RECORD", 2), ("SCHEMA", 1)]


def test_topic_options():
    got = ingest.topic_options("h:9092", "t", client="c", compression="gzip", batch_size=10)
    assert got == {
        "kafka.bootstrap.servers": "h:9092", "topic": "t", "kafka.client.id": "c",
        "kafka.compression.type": "gzip", "kafka.batch.size": "10",
    }


def landed(spark, target, source):
    schema = spark.read.parquet(source).schema
    return rows(reload.read_reloaded(spark, target, schema), "_interval_start", "id")


def test_late_file_under_a_new_checkpoint_adds_rows(spark, folder):
    source, late, target = (f"{folder}/{n}" for n in ("in", "late", "out"))
    arrive(spark, source, *[(i, 1, "a") for i in range(9)])
    reload.reload_from_stream(ingest.stream_files(spark, source, SCHEMA), target, f"{folder}/c1", "ts")
    arrive(spark, late, (9, 1, "late"))
    reload.reload_from_stream(ingest.stream_files(spark, late, SCHEMA), target, f"{folder}/c2", "ts")
    assert landed(spark, target, source) == [(datetime(2024, 1, 1), i) for i in range(10)]


def test_compaction_keeps_rows_and_removes_folders(spark, folder):
    source, target = f"{folder}/in", f"{folder}/out"
    schema = None

    def count_folders():
        rows_ = spark.read.parquet(f"{target}/rows")
        return rows_.select("_interval_start", "_run", "_batch_id").distinct().count()

    for k in range(3):
        arrive(spark, source, (k, 1, "a"), (10 + k, 2, "b"))
        reload.reload_from_stream(ingest.stream_files(spark, source, SCHEMA), target, f"{folder}/check", "ts")
    schema = spark.read.parquet(source).schema
    want = sorted((datetime(2024, 1, 1 + k // 10), k) for k in (0, 1, 2, 10, 11, 12))
    assert count_folders() == 6 and landed(spark, target, source) == want
    assert reload.compact_reloaded(spark, target, schema) == 2
    assert count_folders() == 2 and landed(spark, target, source) == want
    assert reload.compact_reloaded(spark, target, schema) == 0
    # After it: a replay of all files by a new run, late rows, and a compaction of all that.
    reload.reload_from_stream(ingest.stream_files(spark, source, SCHEMA, files_per_batch=2), target, f"{folder}/again", "ts")
    arrive(spark, source, (20, 1, "late"))
    reload.reload_from_stream(ingest.stream_files(spark, source, SCHEMA), target, f"{folder}/check", "ts")
    want = sorted([*want, (datetime(2024, 1, 1), 20)])
    assert landed(spark, target, source) == want
    reload.compact_reloaded(spark, target, schema)
    assert landed(spark, target, source) == want and count_folders() == 2


def test_a_batch_that_was_not_finished_is_not_seen(spark, folder):
    """Rows of a new run are there, its list of origins is not: the old rows still count, once."""
    source, target = f"{folder}/in", f"{folder}/out"
    arrive(spark, source, (1, 1, "a"), (2, 2, "a"))
    reload.reload_from_stream(ingest.stream_files(spark, source, SCHEMA), target, f"{folder}/c1", "ts")
    half = spark.read.parquet(f"{target}/rows").selectExpr("id", "ts", "kind", "_origin", "_from_run + 5 AS _from_run", "_interval_start", "_run + 5 AS _run", "_batch_id")
    half.write.partitionBy("_interval_start", "_run", "_batch_id").mode("append").parquet(f"{target}/rows")
    assert landed(spark, target, source) == [(datetime(2024, 1, 1), 1), (datetime(2024, 1, 2), 2)]


def test_weeks_on_a_stream_begin_on_sunday(spark, folder):
    source, target, checkpoint = (f"{folder}/{n}" for n in ("in", "out", "check"))
    keys, weekly = ["interval_start", "interval_end"], None
    for items in ([(1, 6, "a"), (2, 7, "a")], [(3, 13, "a"), (4, 14, "a")], [(5, 6, "late")], [(6, 28, "a")], [(7, 28, "a")], [(8, 6, "too late")]):
        arrive(spark, source, *items)
        weekly = state.scheduled_stream(ingest.stream_files(spark, source, SCHEMA), "ts", "@weekly", F.count("*").alias("n"), delay="8 days")
        state.write_changes(weekly, target, checkpoint, keys)
    got = rows(state.read_current(spark, target, weekly.schema, keys), "interval_start", "n")
    assert got == [(datetime(2023, 12, 31), 2), (datetime(2024, 1, 7), 2), (datetime(2024, 1, 14), 1), (datetime(2024, 1, 28), 2)]
