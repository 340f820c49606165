"""Accept or reject by name similarity, project, look up child records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.functions.text import is_similar
from rillwork.operators.flow import label_routes
from rillwork.operators.relational import chained_lookup
from rillwork.operators.similarity import similar_names
from rillwork.session import settle


def fuzzy_match(df: DataFrame, requested: str, returned: str, threshold: int, column: str = "route") -> DataFrame:
    """Name the route of each pair: 'valid' above the threshold, else 'error'."""
    return label_routes(df, {"valid": is_similar(returned, requested, threshold)}, "error", column)


def match_tables(
    requested: DataFrame,
    returned: DataFrame,
    requested_name: str,
    returned_name: str,
    returned_key: str,
    children: DataFrame,
    child_key: str,
    child_order: Sequence[str],
    threshold: int = 96,
    limit: int = 50,
) -> dict[str, DataFrame]:
    """As ``match_and_enrich``, for two tables that are not paired yet: 'valid' has each requested row with the returned row
    of the highest score above the threshold (then the smallest name, then the smallest key), 'error' the requested rows
    without one, 'works' up to ``limit`` child records of each returned key that was found."""
    found = settle(similar_names(requested, returned, requested_name, returned_name, threshold), "similar")
    keyed = returned.select(F.lower(returned_name).alias("right_name"), F.col(returned_name).alias("_name"), F.col(returned_key).alias("_key"))
    rated = found.join(keyed, "right_name").groupBy("left_name")
    best = rated.agg(F.min(F.struct((-F.col("score")).alias("worst"), "_name", "_key")).alias("_best"))
    best = best.select("left_name", F.col("_best._name").alias(returned_name), F.col("_best._key").alias(returned_key), (-F.col("_best.worst")).alias("score"))
    best = settle(best, "best")
    named = requested.withColumn("left_name", F.lower(requested_name))
    valid = named.join(best, "left_name").drop("left_name")
    error = named.join(best, "left_name", "left_anti").drop("left_name")
    parents = best.select(returned_key).distinct()
    works = chained_lookup(parents, children, returned_key, child_key, child_order, limit, descending=True)
    return {"valid": valid, "error": error, "works": works}


def match_and_enrich(
    pairs: DataFrame,
    requested: str,
    returned: str,
    key: str,
    projection: Sequence[str],
    children: DataFrame,
    child_key: str,
    child_order: Sequence[str],
    threshold: int = 96,
    limit: int = 50,
) -> dict[str, DataFrame]:
    """Pairs of requested and returned names as three outputs: the accepted ones (projected), the
    rejected ones, and up to ``limit`` child records of each accepted one. The routed pairs are settled,
    so that names are compared once and not once per output."""
    routed = settle(fuzzy_match(pairs, requested, returned, threshold), "routed")
    valid = routed.filter(F.col("route") == "valid").select(*projection)
    works = chained_lookup(valid, children, key, child_key, child_order, limit, descending=True)
    return {"valid": valid, "error": routed.filter(F.col("route") == "error").drop("route"), "works": works}
