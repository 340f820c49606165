"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.session import settle


def mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def stars(links: DataFrame) -> DataFrame:
    """(u, v) for links (u, v) between comparable ids: each node u beside the smallest node v that it can reach, the
    smallest nodes themselves left out.

    A round writes its links. The smallest neighbours are written before they are joined back, so that the join of a
    node with very many links is split; what makes them is summed up on the map side.
    """
    links = links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = settle(links.distinct(), "links")
    before = None
    while (seen := mark(now)) != before and seen[0]:
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = settle(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
    return now
