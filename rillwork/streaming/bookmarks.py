"""Bookmarks per stream, kept from STATE messages, and extracts that go on from them.

The state of a stream is its furthest bookmark. It only moves forward, so a message that comes late or twice changes nothing.
An extract reads the partitions after the bookmark: the days to read come from the bookmark by a join, and Spark prunes
the scan by them when it runs.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rillwork.session import rocksdb_state
from rillwork.streaming.state import read_current, write_changes

BOOKMARKS = T.StructType([T.StructField("stream", T.StringType()), T.StructField("bookmark", T.DateType())])


class Furthest(StatefulProcessor):
    """Holds the furthest bookmark of a stream and emits it when it moves. After ``expiry`` milliseconds without messages
    the next one begins anew, wherever it stands; None keeps a bookmark for good.

    The time is held beside the bookmark: with Spark's own expiry of states a job that processes what is there would not
    come to its end.
    """

    def __init__(self, expiry: int | None = None):
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("bookmark", "bookmark date, at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known, at = self.held.get() if self.held.exists() else (None, 0)
        now = time.time_ns() // 1_000_000
        if known is not None and self.expiry is not None and now - at > self.expiry:
            known = None
        furthest = max((r["bookmark"] for r in rows if r["bookmark"] is not None), default=None)
        if furthest is not None:
            self.held.update((furthest if known is None else max(known, furthest), now))
            if known is None or furthest > known:
                yield Row(stream=key[0], bookmark=furthest)

    def close(self) -> None:
        pass


def furthest(messages: DataFrame, expiry: int | None = None) -> DataFrame:
    """The moves of each stream's bookmark. ``messages``: a stream of (stream, bookmark); null streams and bookmarks say
    nothing. Expiry goes by processing time, in milliseconds."""
    own = messages.select(F.col("stream").cast("string").alias("stream"), F.col("bookmark").cast("date").alias("bookmark"))
    grouped = own.filter("stream IS NOT NULL AND bookmark IS NOT NULL").groupBy("stream")
    return grouped.transformWithState(Furthest(expiry), BOOKMARKS, "Update", "None")


def keep_bookmarks(messages: DataFrame, path: str, checkpoint: str, expiry: int | None = None) -> None:
    """Take in what messages there are and write the bookmarks that moved."""
    with rocksdb_state(messages.sparkSession):
        write_changes(furthest(messages, expiry), path, checkpoint, ["stream"])


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """(stream, bookmark) as last written."""
    return read_current(spark, path, BOOKMARKS, ["stream"])


def days_after(bookmarks: DataFrame, stream: str, first: str, last: str) -> DataFrame:
    """The days from the one after the stream's bookmark (``first`` if it has none) to ``last``: a row each, so their number is bounded
    by the calendar."""
    own = bookmarks.filter(F.col("stream") == stream)
    begin = F.coalesce(F.date_add(F.max("bookmark"), 1), F.lit(first).cast("date"))
    span = own.agg(begin.alias("begin")).withColumn("last", F.lit(last).cast("date")).filter("begin <= last")
    return span.select(F.explode(F.sequence("begin", "last")).alias("day"))


def extract_after(df: DataFrame, bookmarks: DataFrame, stream: str, day: str, first: str, last: str) -> DataFrame:
    """Rows of a table partitioned by ``day`` that come after the stream's bookmark, up to the day ``last``. Partitions before
    it are not listed among the files to read: the join prunes them."""
    days = days_after(bookmarks, stream, first, last).select(F.col("day").alias(day))
    return df.join(F.broadcast(days), day, "left_semi")
