import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.operators import batches
from rillwork.session import settle
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, many small groups, and a null group."""
    group = (
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 50 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 400).cast("string")))
    )
    df = spark.range(30_000).select(group.alias("g"), F.xxhash64("id").alias("k"), F.col("id").alias("payload"))
    return settle(df)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("group", [["g"], []])
def test_sliced_numbers_equal_window(skewed, group, descending):
    sliced = batches.number_rows(skewed, group, ["k"], "n", descending, rows_per_task=700)
    order = F.desc("k") if descending else F.asc("k")
    whole = skewed.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(order)).cast("long"))
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and "SinglePartition" not in plan
    assert sliced.exceptAll(whole).count() == 0 and whole.exceptAll(sliced).count() == 0


def test_hot_group_is_cut(spark, skewed, monkeypatch):
    written = {}
    monkeypatch.setattr(batches, "settle", lambda df, label: written.setdefault(label, settle(df, label)))
    batches.number_rows(skewed, ["g"], ["k"], "n", rows_per_task=700)
    # No task sorts more than a few times the wished number of rows.
    sizes = written["ranges"].groupBy("_range").count()
    assert sizes.count() > 30 and sizes.agg(F.max("count")).first()[0] < 3_000


def test_ties_and_all_equal_keys(spark):
    df = spark.range(5_000).select(F.lit("one").alias("g"), (F.col("id") % 2).alias("k"))
    got = batches.number_rows(df, ["g"], ["k"], "n", rows_per_task=500)
    assert [r.n for r in got.orderBy("n").collect()] == list(range(1, 5_001))


def test_chunks_and_summary(skewed):
    chunks = batches.chunk_rows(skewed, 64, ["g"], ["k"], rows_per_task=700)
    counted = chunks.groupBy("g").agg(F.count("*").alias("n_rows"), F.max("batch_num").alias("n_batches"))
    summary = batches.batch_summary(skewed, 64, ["g"])
    assert counted.exceptAll(summary).count() == 0 and summary.exceptAll(counted).count() == 0
    assert chunks.groupBy("g", "batch_num").count().agg(F.max("count")).first()[0] == 64


def test_limit_beyond_the_window_threshold(spark, skewed):
    small, large = (batches.limit_per_key(skewed, ["g"], ["k"], n, alias="n") for n in (2, 2_000))
    assert small.groupBy("g").count().agg(F.max("count")).first()[0] == 2
    assert large.filter("g = 'hot'").count() == 2_000
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    hot = skewed.filter("g = 'hot'").orderBy("k").limit(2_000).agg(F.sum("payload")).first()
    assert large.filter("g = 'hot'").agg(F.sum("payload")).first() == hot


def test_batch_size_is_checked(skewed):
    with pytest.raises(ValueError):
        batches.chunk_rows(skewed, 0, ["g"], ["k"])


def test_order_spans_groups(spark):
    df = spark.createDataFrame([("b", 10_000), ("a", 2), ("b", 9_999), ("a", 1)], "g string, batch_num int")
    assert [tuple(r) for r in batches.order_batches(df, ["g"]).collect()] == [("a", 1), ("a", 2), ("b", 9_999), ("b", 10_000)]


def test_numbers_of_a_frame_read_by_key_columns_only(skewed):
    numbered = batches.number_rows(skewed, ["g"], ["k"], "n", rows_per_task=700)
    assert rows(numbered.select("g", "n").filter("g = 'hot' and n <= 2"), "n") == [(1,), (2,)]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_numbers_by_time_in_a_zone_with_summer_time(spark, kind):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        minutes = F.timestamp_seconds(F.lit(1_729_980_000) + F.col("id") * 7)  # the night the clocks go back
        df = spark.range(6_000).select((F.col("id") % 2).alias("g"), minutes.cast(kind).alias("at"), "id")
        got = batches.number_rows(df, ["g"], ["at", "id"], "n", rows_per_task=500)
        want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("at", "id")).cast("long"))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        by_time = batches.number_rows(df, ["at"], ["id"], "n", rows_per_task=500)
        assert by_time.agg(F.count("*"), F.min("n")).first()[0] == 6_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
