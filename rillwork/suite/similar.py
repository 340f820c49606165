"""Names of two tables that are not paired beforehand."""

from pyspark.sql import functions as F

from rillwork.operators.similarity import join_similar
from rillwork.plans.matching import match_tables
from rillwork.suite.registry import query, table

# The requested names, and the returned ones: in capitals, with a letter more, one less, one doubled, one put
# elsewhere, one replaced, or with another word for a sign.
REQUESTED_SQL = "SELECT p_partkey, p_name || ' ' || lower(p_type) || ' ' || p_brand || ' ' || p_partkey AS requested FROM part"
RETURNED_SQL = f"""SELECT p_partkey AS returned_key, CASE p_partkey % 7
        WHEN 0 THEN upper(requested) WHEN 1 THEN requested || 's' WHEN 2 THEN substr(requested, 1, 3) || substr(requested, 5)
        WHEN 3 THEN substr(requested, 1, 6) || substr(requested, 6) WHEN 4 THEN substr(requested, 2, 4) || substr(requested, 1, 1) || substr(requested, 6)
        WHEN 5 THEN 'z' || substr(requested, 2) ELSE replace(requested, '#', ' no ') END AS returned FROM ({REQUESTED_SQL})"""


def similar_sql(threshold: int) -> str:
    """Pairs (a, b, score) of distinct lower-cased names above the threshold. Matched characters leave at least as many over as
    letters must be edited, so the distance bounds what has to be measured. Then the longest common part, first in a,
    then in b, is taken out again and again, and what stands left and right of it goes on."""
    part = "len(todo[1].s)"
    inner = "list_transform(range(1, {n} - i + 2), lambda k: CASE WHEN contains(todo[1].t, substr(todo[1].s, i, k)) THEN {{'k': k, 'i': -i}} END)".format(n=part)
    best = f"list_max(list_filter(flatten(list_transform(range(1, {part} + 1), lambda i: {inner})), lambda x: x IS NOT NULL))"
    return f"""names_a AS (SELECT DISTINCT lower(requested) AS a FROM asked), names_b AS (SELECT DISTINCT lower(returned) AS b FROM given),
    near AS (SELECT a, b, length(a) + length(b) AS n FROM names_a, names_b
        WHERE abs(length(a) - length(b)) * 200 <= (200 - 2 * {threshold} - 1) * (length(a) + length(b))
        AND levenshtein(a, b) * 200 <= (200 - 2 * {threshold} - 1) * (length(a) + length(b))),
    walk AS (
        SELECT a, b, n, [{{'s': a, 't': b}}] AS todo, 0 AS matched FROM near
        UNION ALL
        SELECT a, b, n, CASE WHEN best IS NULL THEN todo[2:] ELSE list_concat([
            {{'s': substr(todo[1].s, 1, -best.i - 1), 't': substr(todo[1].t, 1, spot - 1)}},
            {{'s': substr(todo[1].s, -best.i + best.k), 't': substr(todo[1].t, spot + best.k)}}], todo[2:]) END,
            matched + coalesce(best.k, 0)
        FROM (SELECT *, strpos(todo[1].t, substr(todo[1].s, -best.i, best.k)) AS spot FROM (SELECT *, {best} AS best FROM walk WHERE len(todo) > 0))),
    alike AS (SELECT a, b, CAST(round_even(200.0 * matched / n, 0) AS INTEGER) AS score FROM walk WHERE len(todo) = 0 AND round_even(200.0 * matched / n, 0) > {threshold})"""


def _asked(spark, sf):
    name = F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand", "p_partkey")
    return table(spark, sf, "part").select("p_partkey", name.alias("requested"))


def _given(spark, sf):
    asked, name, kind = _asked(spark, sf), F.col("requested"), F.col("p_partkey") % 7

    def piece(begin: int, n: int = 1 << 20):
        return F.substring(name, begin, n)

    returned = (
        F.when(kind == 0, F.upper(name))
        .when(kind == 1, F.concat(name, F.lit("s")))
        .when(kind == 2, F.concat(piece(1, 3), piece(5)))
        .when(kind == 3, F.concat(piece(1, 6), piece(6)))
        .when(kind == 4, F.concat(piece(2, 4), piece(1, 1), piece(6)))
        .when(kind == 5, F.concat(F.lit("z"), piece(2)))
        .otherwise(F.replace(name, F.lit("#"), F.lit(" no ")))
    )
    return asked.select(F.col("p_partkey").alias("returned_key"), returned.alias("returned"))


def _joined_sql(threshold: int) -> str:
    return f"""WITH RECURSIVE asked AS ({REQUESTED_SQL}), given AS ({RETURNED_SQL}), {similar_sql(threshold)}
    SELECT p_partkey, requested, returned_key, returned, score FROM asked JOIN alike ON a = lower(requested) JOIN given ON b = lower(returned)"""


@query("similar_names", _joined_sql(96))
def similar_names(spark, sf):
    """All pairs above 96 of two tables of names."""
    return join_similar(_asked(spark, sf), _given(spark, sf), "requested", "returned", 96)


@query("similar_names_loose", _joined_sql(94))
def similar_names_loose(spark, sf):
    """The same at 94, where more edits are alike enough."""
    return join_similar(_asked(spark, sf), _given(spark, sf), "requested", "returned", 94)


@query(
    "match_tables",
    f"""WITH RECURSIVE asked AS ({REQUESTED_SQL}), given AS ({RETURNED_SQL} WHERE p_partkey % 3 <> 1), {similar_sql(96)},
    best AS (SELECT requested, p_partkey, score, returned, returned_key FROM asked JOIN alike ON a = lower(requested) JOIN given ON b = lower(returned)
        QUALIFY row_number() OVER (PARTITION BY lower(requested) ORDER BY score DESC, returned, returned_key) = 1)
    SELECT 'valid' AS output, p_partkey, returned AS detail, score FROM best
    UNION ALL SELECT 'error', p_partkey, requested, NULL FROM asked WHERE p_partkey NOT IN (SELECT p_partkey FROM best)
    UNION ALL SELECT 'works', returned_key, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR), NULL FROM (SELECT DISTINCT returned_key FROM best)
    JOIN (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem) ON l_partkey = returned_key
    QUALIFY row_number() OVER (PARTITION BY returned_key ORDER BY l_orderkey DESC, l_linenumber DESC) <= 10""",
)
def match_names(spark, sf):
    """Requested names matched to a third of the returned ones less, and the order lines of the parts that were found."""
    given = _given(spark, sf).filter(F.col("returned_key") % 3 != 1)
    children = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber").distinct()
    out = match_tables(_asked(spark, sf), given, "requested", "returned", "returned_key", children, "l_partkey", ["l_orderkey", "l_linenumber"], 96, 10)
    none = F.lit(None).cast("int").alias("score")
    valid = out["valid"].select(F.lit("valid").alias("output"), "p_partkey", F.col("returned").alias("detail"), "score")
    error = out["error"].select(F.lit("error").alias("output"), "p_partkey", F.col("requested").alias("detail"), none)
    line = F.concat_ws("/", "l_orderkey", "l_linenumber").alias("detail")
    works = out["works"].select(F.lit("works").alias("output"), F.col("returned_key").alias("p_partkey"), line, none)
    return valid.unionByName(error).unionByName(works)
