from datetime import datetime

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rillwork.functions.extensions import register_running_batches
from rillwork.sources.emitted import allows, register_emitter
from rillwork.streaming.ingest import ingest
from tests.conftest import rows


def pages(folder, shown):
    """Units are files of a folder; which ones a query asks for is noted."""

    def units(conditions):
        import os

        with open(shown, "a") as out:
            out.write(f"{sorted(conditions.items())}\n")
        names = sorted(os.listdir(folder))
        return [n for n in names if allows(conditions.get("page", []), int(n), int(n))]

    def emit(unit):
        with open(f"{folder}/{unit}") as file:
            words = file.read().split()
        yield [{"page": int(unit), "word": w} for w in words[:1]]
        yield pd.DataFrame({"word": words[1:2], "page": int(unit)})
        yield pa.RecordBatch.from_pydict({"page": pa.array([int(unit)] * len(words[2:]), pa.int32()), "word": words[2:]})

    return units, emit


def test_batches_and_conditions(spark, tmp_path):
    folder, shown = tmp_path / "pages", tmp_path / "shown"
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}").write_text(f"a{i} b{i} c{i} d{i}")
    register_emitter(spark, "pages", "page long, word string", *pages(str(folder), str(shown)))
    every = spark.read.format("pages").load()
    assert rows(every) == sorted((i, f"{c}{i}") for i in range(4) for c in "abcd")
    shown.write_text("")
    some = spark.read.format("pages").load().filter((F.col("page") >= 2) & (F.col("word") != "a2"))
    assert rows(some) == sorted((i, f"{c}{i}") for i in (2, 3) for c in "abcd" if (c, i) != ("a", 2))
    assert some.rdd.getNumPartitions() == 2 and "'page', [('>=', 2)]" in shown.read_text()


def test_stream_goes_on_after_a_restart(spark, tmp_path, folder):
    source = tmp_path / "pages"
    source.mkdir()
    for part in (("0", "1"), (), ("2",)):
        for name in part:
            (source / name).write_text(f"x{name} y{name}")
        register_emitter(spark, "pages", "page long, word string", *pages(str(source), str(tmp_path / "shown")))
        ingest(spark.readStream.format("pages").load(), f"{folder}/out", f"{folder}/check")
    assert rows(spark.read.parquet(f"{folder}/out")) == [(i, f"{c}{i}") for i in range(3) for c in "xy"]


def test_conditions_on_ranges():
    assert allows([("=", 3), ("in", [9, 4])], 3, 5) and not allows([("in", [9])], 3, 5)
    assert [allows([(s, 3)], 3, 5) for s in ("<", "<=", ">", ">=")] == [False, True, True, True]
    assert not allows([(">", 5)], 3, 5) and allows([], 0, 0)


def test_running_batches(spark):
    register_running_batches(spark)
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", at.replace(minute=m), m, float(m)) for m in range(5)] + [("b", at, None, 1.5)], "k string, ts timestamp_ntz, n int, x double").repartition(3)
    call = "running_batches(TABLE(SELECT * FROM {df}) PARTITION BY k ORDER BY ts, size => 2, value => '%s', keep => 'k')"
    got = spark.sql(f"SELECT * FROM {call % 'n'}", df=df)
    assert dict(got.dtypes) == {"k": "string", "batch_num": "bigint", "n_rows": "bigint", "total": "bigint", "running": "bigint"}
    assert rows(got) == [("a", 1, 2, 1, 1), ("a", 2, 2, 5, 6), ("a", 3, 1, 4, 10), ("b", 1, 1, 0, 0)]
    assert spark.sql(f"SELECT * FROM {call % 'x'}", df=df).schema["running"].dataType.simpleString() == "double"


@pytest.mark.parametrize("arguments", ["size => 0, value => 'n', keep => 'k'", "size => 2, value => 'k', keep => 'k'", "size => 2, value => 'n', keep => 'nothing'"])
def test_wrong_arguments_of_running_batches(spark, arguments):
    register_running_batches(spark)
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM running_batches(TABLE(SELECT * FROM {{df}}) PARTITION BY k, {arguments})", df=df).collect()
