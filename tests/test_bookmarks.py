from datetime import date

from pyspark.sql import functions as F

from rillwork.streaming import bookmarks, ingest
from tests.conftest import rows

SCHEMA = "stream string, bookmark string"


def send(spark, folder, *messages, expiry=None):
    spark.createDataFrame(list(messages), SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    bookmarks.keep_bookmarks(ingest.stream_files(spark, f"{folder}/in", SCHEMA), f"{folder}/marks", f"{folder}/check", expiry)
    return rows(bookmarks.read_bookmarks(spark, f"{folder}/marks"))


def test_bookmarks_only_move_forward(spark, folder):
    assert send(spark, folder, ("a", "2024-01-02"), ("a", "2024-01-01"), ("b", "2024-01-01"), (None, "2024-01-01"), ("c", None)) == [("a", date(2024, 1, 2)), ("b", date(2024, 1, 1))]
    assert send(spark, folder, ("a", "2024-01-01"), ("b", "2024-01-05")) == [("a", date(2024, 1, 2)), ("b", date(2024, 1, 5))]
    assert send(spark, folder, ("a", "2024-01-02")) == [("a", date(2024, 1, 2)), ("b", date(2024, 1, 5))]


def test_session_with_the_default_state_provider(spark, folder):
    key, default = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    known = spark.conf.get(key)
    spark.conf.set(key, default)
    try:
        assert send(spark, folder, ("a", "2024-01-02")) == [("a", date(2024, 1, 2))]
        assert send(spark, folder, ("a", "2024-01-01"), ("b", "2024-01-03")) == [("a", date(2024, 1, 2)), ("b", date(2024, 1, 3))]
        assert spark.conf.get(key) == default
    finally:
        spark.conf.set(key, known)


def test_expired_bookmark_starts_anew(spark, folder):
    import time

    assert send(spark, folder, ("a", "2024-01-09"), expiry=1) == [("a", date(2024, 1, 9))]
    time.sleep(0.05)
    assert send(spark, folder, ("a", "2024-01-03"), expiry=1) == [("a", date(2024, 1, 3))]


def test_each_extract_reads_new_partitions_only(spark, folder):
    days = spark.range(1000).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")))
    days.repartition("day").write.partitionBy("day").parquet(f"{folder}/daily")
    daily, known = spark.read.parquet(f"{folder}/daily"), spark.createDataFrame([], bookmarks.BOOKMARKS)
    for first, last in ((1, 5), (6, 6), (7, 20)):
        some = bookmarks.extract_after(daily, known, "s", "day", "2024-01-01", f"2024-01-{last:02}")
        assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString()
        assert rows(some.select("day").distinct()) == [(date(2024, 1, d),) for d in range(first, last + 1)]
        send(spark, folder, ("s", f"2024-01-{last:02}"), ("other", "2024-06-01"))
        known = bookmarks.read_bookmarks(spark, f"{folder}/marks")
    again = bookmarks.extract_after(daily, known, "s", "day", "2024-01-01", "2024-01-20")
    assert again.count() == 0
