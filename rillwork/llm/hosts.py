"""Empirical-Bayes host reputation for URL filters, with DataFrame functions only.

Labelled page outcomes are shrunk through beta-binomial priors from host to registered domain to suffix: the suffix
leans on the overall rate, the domain on its suffix, the host on its domain. The weight of each prior is estimated from
the spread of the rates one level below it (method of moments). A host is blocked when the lower bound of its posterior
rate of bad pages exceeds a limit; the bound is that of a normal approximation. Rules for hosts and path prefixes come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import renamed
from rillwork.session import settle

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What stands between user and port, and which of these are addresses: four numbers, or anything in brackets.
NAME = r"(?s)^(?:.*@)?(\[[^\]]*\]|[^:]*)"
ADDRESS = r"^(\[.*|[0-9]{1,3}(\.[0-9]{1,3}){3})$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Weights of a prior, in pages, between which the estimate is kept.
WEIGHTS = (1.0, 10000.0)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or other texts."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def name_of(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_extract(host, NAME, 1)


def is_address(name: Column) -> Column:
    return F.rlike(name, F.lit(ADDRESS))


def suffix_of(host: Column) -> Column:
    """The last label; an address has no labels and is its own suffix."""
    name = name_of(host)
    return F.when(is_address(name), name).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain, taken as the last two labels; an address is its own domain."""
    name = name_of(host)
    return F.when(is_address(name), name).otherwise(F.substring_index(name, ".", -2))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules are (verdict, ``host/path``), a short literal list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + rest))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def prior_weight(groups: DataFrame) -> DataFrame:
    """One row: the overall rate and the weight, in pages, of a prior over groups with ``n`` pages, ``bad`` of them bad."""
    total = groups.agg(F.sum("n").alias("pages"), F.sum("bad").alias("bads"), F.count("*").alias("k"),
                       F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
                       F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("spread"))
    rate = (F.coalesce(F.col("bads"), F.lit(0)) + 0.5) / (F.coalesce(F.col("pages"), F.lit(0)) + 1.0)
    total = total.select(rate.alias("rate"), "pages", "bads", "k", "squares", "spread")
    inner = F.col("bads").cast("double") * F.col("bads") / F.col("pages")
    noise = F.col("rate") * (1 - F.col("rate"))
    effective = F.col("pages") - F.col("squares") / F.col("pages")
    between = (F.col("spread") - inner - (F.col("k") - 1) * noise) / F.when(effective > 0, effective)
    weight = F.when(between > 0, noise / between - 1).otherwise(WEIGHTS[1])
    return total.select("rate", F.greatest(F.lit(WEIGHTS[0]), F.least(F.lit(WEIGHTS[1]), weight)).alias("weight"))


def reputation(outcomes: DataFrame, z: float = 1.64, others: DataFrame | None = None) -> DataFrame:
    """Hosts with ``n`` labelled pages: posterior ``mean`` and lower ``bound`` of the rate of bad pages.

    ``outcomes`` has host and bad (0 or 1), one row per labelled page; null outcomes count for nothing. Pages are
    pre-aggregated before the shuffle, so a host with a third of them costs one row per task. The hosts of ``others``
    that have no labelled pages lean on their domain, else its suffix, else the overall rate, with ``n`` 0; without any
    labelled page they are left out.
    """
    known = outcomes.filter("bad IS NOT NULL")
    hosts = settle(known.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")), "hosts")
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    counts = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains, suffixes = hosts.groupBy("domain", "suffix").agg(*counts), hosts.groupBy("suffix").agg(*counts)
    levels = [prior_weight(g).select("rate", "weight") for g in (suffixes, domains, hosts)]
    (rate, w_suffix), (_, w_domain), (_, w_host) = [g.first() for g in levels]  # two numbers each

    def lean(rate: Column, weight: float) -> Column:
        return (F.col("bad") + weight * rate) / (F.col("n") + weight)

    suffixes = suffixes.select("suffix", lean(F.lit(rate), w_suffix).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", lean(F.col("suffix_mean"), w_domain).alias("domain_mean"))
    mean = lean(F.col("domain_mean"), w_host)
    joined = hosts.join(domains, "domain").select("host", "n", mean.alias("mean"))
    if others is not None and not hosts.isEmpty():
        new = others.select("host").distinct().join(hosts, "host", "left_anti")
        new = new.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
        new = new.join(domains, "domain", "left").join(suffixes, "suffix", "left")
        joined = joined.unionByName(new.select("host", F.lit(0).cast("long").alias("n"), F.coalesce("domain_mean", "suffix_mean", F.lit(rate)).alias("mean")))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + w_host + 1))
    return joined.select("host", "n", "mean", (F.col("mean") - z * sd).alias("bound"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]],
    page_id: str = "page_id",
    url: str = "url",
    z: float = 1.64,
    limit: float = 0.35,
    unlabelled: bool = False,
) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), bound: the verdict of the longest rule, else block if the
    host's posterior bound exceeds ``limit``.

    ``outcomes`` has page_id and bad (0 or 1). A null or odd url has empty host and path and is judged like any host;
    hosts without labelled pages are allowed, with a null bound, or with ``unlabelled`` judged by the bound that their
    domain, suffix or the overall rate gives (still allowed if no page at all is labelled); repeated rows are judged each; a page that several
    outcomes name counts with each of them; other columns of the inputs are never touched.
    """
    own = renamed(pages, page_id=page_id, url=url)
    parts = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = renamed(outcomes, page_id="page_id", bad="bad").filter("page_id IS NOT NULL")
    others = parts if unlabelled else None
    hosts = settle(reputation(parts.select("page_id", "host").join(labels, "page_id"), z, others), "reputation")
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("bound") > limit, "block").otherwise("allow")
    joined = parts.join(hosts.select("host", F.round("bound", 6).alias("bound")), "host", "left")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, learnt).alias("verdict"), "bound")
