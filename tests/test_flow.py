import pytest
from pyspark.sql import functions as F

from rillwork.functions import extensions
from rillwork.operators import flow, relational
from rillwork.plans.matching import match_and_enrich
from rillwork.suite import QUERIES
from tests.conftest import rows


def test_null_condition_goes_to_otherwise(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    parts = flow.split_if_then(df, F.col("x") > 0)
    assert rows(parts["then"]) == [(1,)]
    assert {r.x for r in parts["otherwise"].collect()} == {-1, None}


def test_two_way_split(spark):
    names = flow.branch_rows(spark, ["John", "Martha", "Mathew", "Karla"], "name string")
    parts = flow.split_if_then(names, F.col("name").endswith("a"))
    assert rows(parts["then"]) == [("Karla",), ("Martha",)]
    assert rows(parts["otherwise"]) == [("John",), ("Mathew",)]


def test_branches_of_dicts(spark):
    files = flow.branch_rows(spark, [{"filename": "users.txt", "contents": "John"}, {"filename": "b", "contents": None}], "filename string, contents string")
    assert [tuple(r) for r in files.orderBy("filename").collect()] == [("b", None), ("users.txt", "John")]


def test_routes_without_default_drop_the_rest(spark):
    df = spark.createDataFrame([("SCHEMA",), ("RECORD",), ("STATE",), ("OTHER",), (None,)], "type string")
    labelled = flow.label_routes(df, {k.lower(): F.col("type") == k for k in ("SCHEMA", "RECORD", "STATE")})
    assert rows(labelled, "route") == [("record",), ("schema",), ("state",)]
    parts = flow.route_by_type(df, ["SCHEMA", "RECORD", "STATE"])
    assert {k: v.count() for k, v in parts.items()} == {"SCHEMA": 1, "RECORD": 1, "STATE": 1}


def test_union_allows_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2,)], "i int")
    assert rows(flow.union_inputs({"a": a, "b": b}).na.fill("", ["s"]), "i", "s", "source") == [(1, "x", "a"), (2, "", "b")]


def test_flatten_rates_golden(spark):
    df = spark.sql(
        "SELECT map('2021-03-12', named_struct('EUR', 0.838012235D, 'HKD', 7.7635129473D, 'PHP', 48.4136428392D, 'base', 'old')) rates, 'USD' base"
    )
    out = flow.flatten_rates(df)
    assert out.first().asDict() == {"EUR": 0.838012235, "HKD": 7.7635129473, "PHP": 48.4136428392, "base": "USD", "date": "2021-03-12"}


def test_steps_in_order(spark):
    df = flow.multi_step(
        flow.branch_rows(spark, [100], "batch int"),
        lambda d: d.withColumn("a", F.lit(2) + F.col("batch")),
        lambda d: d.withColumn("b", F.array(F.lit(0), F.col("batch") + 3)),
        lambda d: d.withColumn("c", F.col("b")[1] + F.lit(10)),
    )
    assert tuple(df.select("a", "c").first()) == (102, 113)


def test_rename_checks_the_count(spark):
    with pytest.raises(ValueError):
        flow.rename_by_position(spark.range(1), ["a", "b"])


def test_fan_out_settles_the_input(spark):
    parts = flow.fan_out(spark.range(10).withColumn("r", F.rand()), {"a": lambda d: d, "b": lambda d: d})
    assert parts["a"].exceptAll(parts["b"]).count() == 0


def test_group_stat_without_key_and_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, 9.0), ("b", None)], "k string, v double")
    got = {(r.k, r.v): r.m for r in relational.join_group_stat(df, "k", "v", "m").collect()}
    assert got == {("a", 1.0): 2.0, ("a", 3.0): 2.0, ("a", None): 2.0, ("b", None): None}


def test_compare_frames_counts_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (3,), (None,), (None,)], "x int")
    got = {(r.x, r.side, r.n_rows) for r in relational.compare_frames(a, b).collect()}
    assert got == {(1, "left", 1), (2, "left", 1), (3, "right", 1), (None, "right", 1)}
    assert relational.compare_frames(a, a).count() == 0


def test_match_and_enrich(spark):
    pairs = spark.createDataFrame([(1, "J. K. Rowling", "j. k. rowling"), (2, "J. K. Rowling", "Rowling Smith")], "key int, requested string, name string")
    works = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 0)], "author int, work int")
    out = match_and_enrich(pairs, "requested", "name", "key", ["key", "name"], works, "author", ["work"], limit=3)
    assert rows(out["valid"]) == [(1, "j. k. rowling")]
    assert rows(out["error"], "key") == [(2,)]
    assert rows(out["works"], "key", "work") == [(1, 6), (1, 7), (1, 8)]


def test_stat_join_broadcasts_by_size_only(spark):
    df = spark.range(1000).select((F.col("id") % 5).alias("k"), F.col("id").cast("double").alias("v"))
    plan = relational.join_group_stat(df, "k", "v", "m")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = relational.join_group_stat(df, "k", "v", "m")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan


def test_user_functions(spark):
    extensions.register_emit_items(spark, "emit_test")
    assert rows(spark.sql("SELECT item_num, item FROM emit_test(array('a', 'b'))")) == [(1, "a"), (2, "b")]
    assert spark.sql("SELECT * FROM emit_test(CAST(NULL AS ARRAY<STRING>))").count() == 0
    square = extensions.column_function(lambda s: s * s, "long")
    assert rows(spark.range(4).select(square("id"))) == [(0,), (1,), (4,), (9,)]

    def twice(batch):
        yield batch
        yield batch

    assert extensions.map_batches(spark.range(3), twice, "id long").count() == 6


def test_shapes_are_picked_once_per_document(spark, folder):
    spark.createDataFrame([(1, "O"), (2, "F"), (3, None)], "o_orderkey long, o_orderstatus string").write.parquet(f"{folder}/orders.parquet")
    lines = [(1, 10, 1, 40.0, 0.07), (1, 11, 2, 1.0, 0.01), (2, 12, 1, None, None), (None, 13, 1, 2.0, 0.1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    found = QUERIES["json_search_shapes"](spark, folder)
    assert rows(found, "order_key", "status", "first_part", "pair", "discounts", "n_large", "part", "quantity") == [
        (1, "O", 10, "1|O", "7", 1, 10, 40.0), (1, "O", 10, "1|O", "7", 1, 11, 1.0), (2, "F", 12, "2|F", "", 0, 12, None)
    ]
    above, _, below = found._jdf.queryExecution().optimizedPlan().toString().partition("Generate ")
    assert "array_join" not in above and below.count("array_join") == 2 and below.count("parseJson") == 1
