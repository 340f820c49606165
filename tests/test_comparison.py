import pytest
from pyspark.sql import functions as F

from rillwork.operators import comparison
from rillwork.operators.comparison import compare_by_ranges
from rillwork.operators.relational import compare_frames
from tests.conftest import rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(50_000).select("id", (F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") * 0.5).alias("b"), F.concat(F.lit("t"), "id").alias("c"))


def test_equal_frames_move_no_rows(spark):
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    got = compare_by_ranges(lines, lines.repartition(3), ["l_orderkey", "l_linenumber"])
    assert (got.ranges, got.compared, got.rows.count()) == (0, 0, 0)
    assert all(r.passed for r in got.columns.collect()) and got.columns.count() == len(lines.columns)


@pytest.mark.parametrize("few", [0, 100_000])
def test_same_rows_as_the_full_comparison(frame, monkeypatch, few):
    monkeypatch.setattr(comparison, "FEW_ROWS", few)
    other = frame.withColumn("b", F.when(F.col("id") == 77, 1.0).when(F.col("id") == 100, None).otherwise(F.col("b")))
    other = other.withColumn("c", F.when(F.col("id").isin(77, 4001), "x").otherwise(F.col("c"))).filter("id != 9")
    other = other.unionByName(frame.filter("id = 12")).unionByName(frame.filter("id = 1").withColumn("id", F.lit(-1).cast("long")))
    got = compare_by_ranges(frame, other, ["id"])
    assert sorted(map(str, got.rows.collect())) == sorted(map(str, compare_frames(frame, other).collect()))
    assert 0 < got.ranges <= 7 and got.compared < (200 if few == 0 else 5000)
    assert {r.column: (r.passed, r.n_different) for r in got.columns.collect()} == {"id": (False, 3), "a": (True, 0), "b": (False, 1), "c": (False, 2)}


def test_nulls_and_repeats(spark):
    left = spark.createDataFrame([(1, None, "a"), (None, 1, "a"), (2, 2, None), (3, 3, "x"), (3, 3, "x")], "k long, v long, w string")
    right = spark.createDataFrame([(1, 1, "a"), (None, None, "a"), (2, 2, None), (3, 3, "x"), (4, 4, "y"), (4, 4, "y")], "k long, v long, w string")
    got = compare_by_ranges(left, right, ["k"])
    assert sorted(map(str, got.rows.collect())) == sorted(map(str, compare_frames(left, right).collect()))
    assert {r.column: r.n_different for r in got.columns.collect()} == {"k": 2, "v": 2, "w": 0}


def test_hashes_tell_nulls_from_neighbours(spark):
    df = spark.createDataFrame([(None, 1), (1, None)], "a long, b long")
    assert df.select(comparison.hashed(["a", "b"], 2).alias("h")).distinct().count() == 2


def test_empty(frame):
    got = compare_by_ranges(frame.limit(0), frame.limit(0), ["id"])
    assert got.rows.count() == 0 and rows(got.columns, "passed") == [(True,)] * 4
    assert compare_by_ranges(frame.limit(3), frame.limit(0), ["id"]).rows.count() == 3
