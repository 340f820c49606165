import os

import pytest
from pyspark.sql import functions as F

from rillwork.sinks import append
from tests.conftest import rows


def content(folder, name):
    with open(f"{folder}/{name}") as file:
        return file.read()


def lines(spark, first, n):
    return spark.range(first, first + n).select("id", F.concat(F.lit("f"), F.col("id") % 3, F.lit(".txt")).alias("name"), F.concat(F.lit("line "), "id", F.lit("\n")).alias("text"))


def want(k, n):
    return "".join(f"line {i}\n" for i in range(n) if i % 3 == k)


def test_appends_in_order(spark, folder):
    append.append_blobs(lines(spark, 30, 30).repartition(4), folder, "name", "text", "id", 2)
    append.append_blobs(lines(spark, 0, 30).repartition(4), folder, "name", "text", "id", 1)
    manifest = append.fold_appends(spark, folder)
    assert rows(manifest, "path") == [("f0.txt",), ("f1.txt",), ("f2.txt",)]
    assert [content(folder, f"f{k}.txt") for k in range(3)] == [want(k, 60) for k in range(3)]
    assert sum(r["size"] for r in manifest.collect()) == sum(len(want(k, 60)) for k in range(3))


def test_a_job_that_dies_and_runs_again_leaves_the_bytes_once(spark, folder, tmp_path):
    append.append_blobs(lines(spark, 0, 30), folder, "name", "text", "id", 1)
    mark = str(tmp_path / "died")

    @F.udf("string")
    def dies_once(text):
        if text.startswith("line 55") and not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("killed midway")
        return text

    more = lines(spark, 30, 30).repartition(4).withColumn("text", dies_once("text"))
    with pytest.raises(Exception, match="killed midway"):
        append.append_blobs(more, folder, "name", "text", "id", 2)
    append.fold_appends(spark, folder)
    assert content(folder, "f0.txt") == want(0, 30)  # nothing of the append that failed
    append.append_blobs(more, folder, "name", "text", "id", 2)
    append.append_blobs(more, folder, "name", "text", "id", 2)  # and once more under its number
    for _ in range(2):
        append.fold_appends(spark, folder)
        assert [content(folder, f"f{k}.txt") for k in range(3)] == [want(k, 60) for k in range(3)]
    assert append.sweep_segments(spark, folder) > 0 and append.sweep_segments(spark, folder) == 0
    append.fold_appends(spark, folder)
    assert content(folder, "f1.txt") == want(1, 60)


def test_nulls_bytes_and_nothing(spark, folder):
    df = spark.createDataFrame([(1, "a/b.bin", b"\x00\xff"), (2, "a/b.bin", None), (3, "/a/b.bin", b"\n")], "i long, p string, d binary")
    append.append_blobs(df, folder, "p", "d", "i", 7)
    append.append_blobs(df.limit(0), folder, "p", "d", "i", 8)
    append.fold_appends(spark, folder)
    with open(f"{folder}/a/b.bin", "rb") as file:
        assert file.read() == b"\x00\xff\n"
    assert append.committed(folder) == [7, 8]
    assert append.read_pieces(spark, f"{folder}/none").count() == 0
