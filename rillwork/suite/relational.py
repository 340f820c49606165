"""Joins, aggregates, comparison, reshaping."""

from pyspark.sql import functions as F

from rillwork.functions.text import similarity, word_count
from rillwork.operators import relational
from rillwork.operators.comparison import compare_by_ranges
from rillwork.plans import matching
from rillwork.plans.matching import match_and_enrich
from rillwork.suite.registry import query, table

# The pairs of names: equal but for case, one letter more, the brand added, the type added.
PAIRS_SQL = """SELECT p_partkey, p_name AS requested, CASE p_partkey % 4
        WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 's'
        WHEN 2 THEN p_name || ' ' || p_brand ELSE p_name || ' ' || p_type END AS returned FROM part"""
# The requested name is the beginning of the returned one: all its characters match.
SCORE_SQL = "CAST(round_even(200.0 * length(requested) / (length(requested) + length(returned)), 0) AS INTEGER)"


def _pairs(spark, sf):
    name, kind = F.col("p_name"), F.col("p_partkey") % 4
    returned = (
        F.when(kind == 0, F.upper(name))
        .when(kind == 1, F.concat(name, F.lit("s")))
        .when(kind == 2, F.concat_ws(" ", name, "p_brand"))
        .otherwise(F.concat_ws(" ", name, "p_type"))
    )
    return table(spark, sf, "part").select("p_partkey", name.alias("requested"), returned.alias("returned"))


@query(
    "join_group_stat",
    """SELECT c_custkey, c_nationkey, c_acctbal, round(mean_acctbal, 6) AS mean_acctbal FROM customer
    JOIN (SELECT c_nationkey, avg(c_acctbal) AS mean_acctbal FROM customer GROUP BY 1) USING (c_nationkey)""",
)
def join_group_stat(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    joined = relational.join_group_stat(customers, "c_nationkey", "c_acctbal", "mean_acctbal")
    return joined.withColumn("mean_acctbal", F.round("mean_acctbal", 6))


@query(
    "chained_lookup",
    """SELECT c_custkey, c_name, o_orderkey, o_orderdate, child_num FROM customer JOIN (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS child_num
        FROM orders) ON c_custkey = o_custkey WHERE child_num <= 5""",
)
def chained_lookup(spark, sf):
    parents = table(spark, sf, "customer").select("c_custkey", "c_name")
    children = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    found = relational.chained_lookup(
        parents, children, "c_custkey", "o_custkey", ["o_orderdate", "o_orderkey"], 5, descending=True
    )
    return found.drop("o_custkey")


@query(
    "fuzzy_match",
    f"""SELECT p_partkey, requested, returned, {SCORE_SQL} AS score,
        CASE WHEN {SCORE_SQL} > 96 THEN 'valid' ELSE 'error' END AS route FROM ({PAIRS_SQL})""",
)
def fuzzy_match(spark, sf):
    scored = _pairs(spark, sf).withColumn("score", similarity("returned", "requested"))
    return matching.fuzzy_match(scored, "requested", "returned", 96)


@query(
    "match_and_enrich",
    f"""WITH routed AS (SELECT *, {SCORE_SQL} > 96 AS ok FROM ({PAIRS_SQL}))
    SELECT 'valid' AS output, p_partkey, requested AS detail FROM routed WHERE ok
    UNION ALL SELECT 'error', p_partkey, returned FROM routed WHERE NOT ok
    UNION ALL SELECT 'works', p_partkey, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) FROM routed
    JOIN (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem) ON l_partkey = p_partkey WHERE ok
    QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) <= 10""",
)
def enrich(spark, sf):
    children = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber").distinct()
    out = match_and_enrich(
        _pairs(spark, sf), "requested", "returned", "p_partkey", ["p_partkey", "requested"],
        children, "l_partkey", ["l_orderkey", "l_linenumber"], threshold=96, limit=10,
    )
    line = F.concat_ws("/", "l_orderkey", "l_linenumber")
    detail = {"valid": F.col("requested"), "error": F.col("returned"), "works": line}
    parts = [df.select(F.lit(n).alias("output"), "p_partkey", detail[n].alias("detail")) for n, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "group_mean",
    """SELECT priority, round(avg(o_totalprice), 4) AS mean_price FROM (
        SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority,
            CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders)
    WHERE priority IS NOT NULL GROUP BY 1""",
)
def group_mean(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("price"),
    )
    means = relational.group_mean(orders, "priority", "price", "mean_price")
    return means.withColumn("mean_price", F.round("mean_price", 4))


@query(
    "word_count",
    r"""SELECT doc_id, len(regexp_split_to_array(text, '[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))
        AS n_words FROM documents""",
)
def count_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", word_count("text").alias("n_words"))


@query(
    "compare_frames",
    """WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders),
    b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
        FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 89 = 0)
    SELECT *, 'left' AS side, count(*) AS n_rows FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL
    UNION ALL
    SELECT *, 'right', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL""",
)
def compare_frames(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    changed = left.filter(F.col("o_orderkey") % 97 != 0).withColumn("o_totalprice", price)
    return relational.compare_frames(left, changed.unionByName(left.filter(F.col("o_orderkey") % 89 == 0)))


@query(
    "pivot_rows",
    """SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT",
        count(*) FILTER (o_orderpriority = '2-HIGH') AS "2-HIGH", count(*) FILTER (o_orderpriority = '3-MEDIUM') AS "3-MEDIUM",
        count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED", count(*) FILTER (o_orderpriority = '5-LOW') AS "5-LOW"
    FROM orders GROUP BY 1""",
)
def pivot_rows(spark, sf):
    values = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    pivoted = relational.pivot_rows(table(spark, sf, "orders"), ["o_orderstatus"], "o_orderpriority", values, F.count(F.lit(1)))
    return pivoted.na.fill(0)


@query(
    "melt_columns",
    """SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part
    UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""",
)
def melt_columns(spark, sf):
    part = table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return relational.melt_columns(part, ["p_partkey"], ["p_size", "p_retailprice"])


# Few rows differ: some prices, some dates taken away, some rows dropped, some twice.
CHANGED_SQL = """a AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders),
    b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 499 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
            CASE WHEN o_orderkey % 998 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 487 <> 0
        UNION ALL SELECT * FROM a WHERE o_orderkey % 491 = 0 AND o_orderkey % 487 <> 0 AND o_orderkey % 499 <> 0),
    surplus AS (SELECT *, 'left' AS side, count(*) AS n_rows FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL
        UNION ALL SELECT *, 'right', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL)"""


def _compared(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    key = F.col("o_orderkey")
    right = left.filter(key % 487 != 0).withColumns({
        "o_totalprice": F.when(key % 499 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
        "o_orderpriority": F.when(key % 998 != 0, F.col("o_orderpriority")),
    })
    again = left.filter((key % 491 == 0) & (key % 487 != 0) & (key % 499 != 0))
    return compare_by_ranges(left, right.unionByName(again), ["o_orderkey"])


@query("compare_ranges", f"WITH {CHANGED_SQL} SELECT * FROM surplus")
def compare_ranges(spark, sf):
    """Rows that differ, found by hashes of ranges: only ranges that differ are compared."""
    return _compared(spark, sf).rows


@query(
    "compare_columns",
    f"""WITH {CHANGED_SQL},
    sides AS (SELECT o_orderkey AS k, CAST(coalesce(sum(n_rows) FILTER (side = 'left'), 0) AS BIGINT) AS l, CAST(coalesce(sum(n_rows) FILTER (side = 'right'), 0) AS BIGINT) AS r FROM surplus GROUP BY 1),
    pairs AS (SELECT x.*, y.o_custkey AS c2, y.o_totalprice AS t2, y.o_orderpriority AS p2 FROM sides JOIN surplus x ON x.o_orderkey = k AND x.side = 'left'
        JOIN surplus y ON y.o_orderkey = k AND y.side = 'right' WHERE l = 1 AND r = 1),
    counts AS (SELECT 'o_orderkey' AS "column", count(*) FILTER (NOT (l = 1 AND r = 1)) AS n FROM sides
        UNION ALL SELECT 'o_custkey', count(*) FILTER (o_custkey IS DISTINCT FROM c2) FROM pairs
        UNION ALL SELECT 'o_totalprice', count(*) FILTER (o_totalprice IS DISTINCT FROM t2) FROM pairs
        UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority IS DISTINCT FROM p2) FROM pairs)
    SELECT "column", n = 0 AS passed, n AS n_different FROM counts""",
)
def compare_columns(spark, sf):
    """Which columns pass, and in how many keys the others differ."""
    return _compared(spark, sf).columns
