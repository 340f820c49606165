"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from rillwork.storage import open_path

# State of streams on local disk instead of in executor memory.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Folders named so far, in order.
_MADE: list[str] = []


def build_session(app: str = "rillwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for.

    Python workers of a local session find this package wherever the program was started; on a cluster install it, or
    send it along with ``spark.submit.pyFiles``. AQE stays on: it coalesces small shuffle partitions, splits skewed join partitions and turns a
    shuffled join into a broadcast join once the real size of a side is known.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.ui.enabled": "false",
        **conf,
    }
    if SparkSession.getActiveSession() is None:  # the JVM that starts now hands this on to Python workers
        root = str(Path(__file__).resolve().parent.parent)
        known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
        os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, known)]))
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Zone-less timestamps are only cast to zoned ones (watermarks) under UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside the block keep their state in RocksDB if the session has Spark's default provider, which cannot
    hold the state of ``transformWithState``. A stream that goes on from a checkpoint keeps its provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    known = spark.conf.get(key)
    if not known.endswith(".HDFSBackedStateStoreProvider"):
        yield
        return
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, known)


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs that run inside the block send Arrow batches of at most about ``size`` bytes to Python, or of one row."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, known)


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named in ``spark.checkpoint.dir``. A session without that setting has its
    warehouse, which they share as well."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/rillwork"


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A folder name below the shared folder that no other run uses."""
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Delete the folders that ``fresh_dir`` names inside the block once it ends: for a step whose result is written."""
    begun = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[begun:]:
            system, place = open_path(path)
            if system.get_file_info(place).type == fs.FileType.Directory:
                system.delete_dir(place)
        del _MADE[begun:]


def written(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The frame that ``make`` gives, written once; what its making left in the shared folder is deleted."""
    path = fresh_dir(spark, label)
    with scratch():
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write a frame once to the shared folder and return the written table.

    Cuts the lineage in a way that survives lost executors, keeps columnar pruning and push-down, and
    gives Catalyst the true size of the result, so that a join against it is planned as a broadcast
    only if the files are below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
