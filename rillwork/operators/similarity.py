"""Join of two tables by similar names.

The score is the one of ``functions.text``: twice the matched characters over all characters, from 0 to 100. Comparing every name with
every other one is out of the question, so pairs are found by what a score above the threshold implies. With M matched
of T characters, T - 2M are left over; each of them spoils at most q - 1 grams of q characters beside its own, so the two names have at least
M - (q - 1)(T - 2M + 1) grams in common. Two sets with that much in common share one of their rarest grams: those
are the join keys. How long a prefix of rare grams a name needs follows from its length and the threshold.

Where few characters may be left over, rare grams are many and not rare enough; such pairs are found by their spelling (``spelling``).

Pairs that meet are dropped by length, by how many grams can still follow the shared one, and by common grams and
characters, all in Spark expressions; only the rest is measured. No pair above the threshold is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions.blocks import measured_at_once
from rillwork.operators.spelling import FEW, left_over, near_pairs
from rillwork.session import settle

#: Counters of the grams' frequencies. Grams that share one only share their place in the order.
COUNTERS = 1 << 14
#: Names of one side that may share a gram in one task; a gram with more is split.
HOT = 20_000


def grams(name: Column, q: int) -> Column:
    """The runs of ``q`` characters as 64-bit hashes, equal ones told apart by their number."""
    places = F.sequence(F.lit(1), F.char_length(name) - (q - 1))
    every = F.when(F.char_length(name) >= q, F.transform(places, lambda i: F.xxhash64(F.substring(name, i, F.lit(q))))).otherwise(F.array())
    # In a list of one list, so that the sorted list is made once and not for each of its elements.
    numbered = F.transform(F.array(F.array_sort(every)), lambda ordered: F.transform(ordered, lambda g, i: F.xxhash64(g, i - F.array_position(ordered, g))))
    return numbered[0]


class Bounds:
    """What a score above ``threshold`` implies, in whole numbers. ``bar`` is 400 times the least share of matched characters
    in all characters: a score is rounded, so it begins half a point lower."""

    def __init__(self, threshold: int):
        self.bar = 2 * threshold + 1

    def slope(self, q: int) -> int:
        return (2 * q - 1) * self.bar - 400 * (q - 1)

    def gram_size(self) -> int:
        """Two where two-character grams tell enough apart, else single characters."""
        return 2 if self.slope(2) >= 20 else 1

    def matched(self, characters: Column) -> Column:
        """The least number of matched characters among so many in both names."""
        return F.ceil(characters * self.bar / 400)

    def needed(self, characters: Column, q: int) -> Column:
        """The least number of common grams, as far as it is positive."""
        least = self.matched(characters)
        return least - (q - 1) * (characters - 2 * least + 1)

    def shortest(self, size: Column) -> Column:
        """The least length of a partner."""
        return F.ceil(size * self.bar / (400 - self.bar))

    def needed_by(self, size: Column, q: int) -> Column:
        """The least number of grams that a name has in common with any partner."""
        return F.ceil((size + self.shortest(size)) * self.slope(q) / 400) - (q - 1)

    def longest(self, size: Column) -> Column:
        """The greatest length of a partner."""
        return F.floor(size * (400 - self.bar) / self.bar)

    def may_leave(self, size: Column, more: int) -> Column:
        """Whether more characters than so many may be left over of a name and a partner: never false where they may."""
        return (size + self.longest(size)) * (200 - self.bar) >= 200 * (more + 1)

    def lengths_fit(self, left: Column, right: Column) -> Column:
        return F.least(left, right) * 400 >= (left + right) * self.bar


def rarity(sides: list[DataFrame]) -> list[int]:
    """How often the grams of each counter occur in both tables: ``COUNTERS`` numbers, whatever the tables."""
    every = sides[0].select(F.explode("grams").alias("gram")).unionByName(sides[1].select(F.explode("grams").alias("gram")))
    counted = every.groupBy(counter(F.col("gram")).alias("c")).agg(F.count("*").alias("n")).collect()
    out = [0] * COUNTERS
    for row in counted:
        out[row.c] = row.n
    return out


def counter(gram: Column) -> Column:
    return F.pmod(gram, F.lit(COUNTERS)).cast("int")


def entries(names: DataFrame, counts: list[int], bounds: Bounds, q: int) -> DataFrame:
    """(gram, at, name, size, grams): the rarest grams of each name, as many as it needs."""
    known = F.split(F.lit(",".join(map(str, counts))), ",").cast("array<bigint>")  # one constant
    order = F.array_sort(F.transform("grams", lambda g: F.struct(F.get(known, counter(g)).alias("often"), g.alias("gram"))))
    prefix = F.size("grams") - F.greatest(bounds.needed_by(F.col("size"), q), F.lit(1)) + 1
    listed = names.filter(F.size("grams") > 0).select("name", "size", "grams", F.slice(order, F.lit(1), prefix.cast("int")).alias("rare"))
    return listed.select("name", "size", "grams", F.posexplode("rare").alias("at", "r")).select(F.col("r.gram").alias("gram"), "at", "name", "size", "grams")


def deal(a: DataFrame, b: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt``: a key that many names of the left side share is dealt to several tasks, the right side's names
    to each of them."""
    hot = settle(a.groupBy(key).agg(F.ceil(F.count("*") / HOT).alias("salts")).filter("salts > 1"), "hot")
    one = F.coalesce("salts", F.lit(1))
    a = a.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(name), one)).drop("salts")
    b = b.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("salts")
    return a, b


def candidates(left: DataFrame, right: DataFrame, bounds: Bounds, q: int, beyond: int = -1) -> DataFrame:
    """Distinct pairs of unlike names that share a rare gram and have enough grams in common, of those of which more than
    ``beyond`` characters may be left over."""
    sides = [s.withColumn("grams", grams(F.col("name"), q)) for s in (left, right)]
    counts = rarity(sides)
    a, b = (settle(entries(s, counts, bounds, q), "grams") for s in sides)
    a, b = deal(a, b, "gram", "name")
    a, b = (s.toDF("gram", *[f"{side}_{c}" for c in ("at", "name", "size", "grams")], "salt") for s, side in ((a, "left"), (b, "right")))
    follow = F.least(F.size("left_grams") - F.col("left_at"), F.size("right_grams") - F.col("right_at"))
    needed = bounds.needed(F.col("left_size") + F.col("right_size"), q)
    met = a.join(b, ["gram", "salt"]).filter(
        (F.col("left_name") != F.col("right_name"))
        & bounds.lengths_fit(F.col("left_size"), F.col("right_size"))
        & (left_over(F.col("left_size") + F.col("right_size"), bounds.bar) > beyond)
        & (follow >= needed)
        & (F.size(F.array_intersect("left_grams", "right_grams")) >= needed)
    )
    return met.select("left_name", "right_name").distinct()


def far_pairs(left: DataFrame, right: DataFrame, bounds: Bounds, q: int, beyond: int) -> DataFrame:
    """The pairs found by grams that have enough characters in common."""
    pairs = candidates(left, right, bounds, q, beyond)
    if q == 1:
        return pairs
    # Names so short that they may have no gram in common with a partner: among themselves by single characters.
    short = bounds.needed_by(F.col("size"), q) <= 0
    pairs = pairs.unionByName(candidates(left.filter(short), right.filter(short), bounds, 1, beyond)).distinct()
    a, b = F.col("left_name"), F.col("right_name")
    shared = F.size(F.array_intersect(grams(a, 1), grams(b, 1)))
    return pairs.filter(shared >= bounds.matched(F.char_length(a) + F.char_length(b)))


def similar_names(left: DataFrame, right: DataFrame, left_on: str, right_on: str, threshold: int, q: int | None = None) -> DataFrame:
    """(left_name, right_name, score): distinct pairs of lower-cased names with a score above ``threshold`` (0 to 99).

    A null name is like nothing. Equal names, empty ones too, score 100; an empty name is like no other one. Names that
    repeat are compared once. With ``q``, all pairs are found by grams of that size.
    """
    if not 0 <= threshold <= 99:
        raise ValueError("the threshold must be from 0 to 99")
    bounds = Bounds(threshold)
    beyond, q = -1 if q else FEW, q or bounds.gram_size()
    if bounds.slope(q) <= 0:
        raise ValueError(f"grams of {q} characters cannot tell names apart at {threshold}")

    def names(df: DataFrame, column: str) -> DataFrame:
        lowered = df.select(F.lower(df[f"`{column}`"]).alias("name")).filter(F.col("name").isNotNull()).distinct()
        return settle(lowered.withColumn("size", F.char_length("name")), "names")

    left, right = names(left, left_on), names(right, right_on)
    equal = left.join(right, "name", "left_semi").select(F.col("name").alias("left_name"), F.col("name").alias("right_name"), F.lit(100).alias("score"))
    far = [side.filter(bounds.may_leave(F.col("size"), beyond)) for side in (left, right)]
    pairs = near_pairs(left, right, bounds.bar, deal) if beyond >= 0 else None
    if beyond < 0 or not any(side.isEmpty() for side in far):
        met = far_pairs(*far, bounds, q, beyond)
        pairs = pairs.unionByName(met) if pairs else met
    pairs = settle(pairs, "pairs")
    return equal.unionByName(pairs.withColumn("score", measured_at_once("left_name", "right_name")).filter(F.col("score") > threshold))


def join_similar(left: DataFrame, right: DataFrame, left_on: str, right_on: str, threshold: int, score: str = "score") -> DataFrame:
    """Rows of both tables whose names are similar, with the score: the pairs are found, not given. Columns must not clash,
    as in any join."""
    found = settle(similar_names(left, right, left_on, right_on, threshold), "similar")
    found = found.select(F.col("left_name").alias("_left_name"), F.col("right_name").alias("_right_name"), F.col("score").alias(score))
    a = left.withColumn("_left_name", F.lower(left[f"`{left_on}`"])).join(found, "_left_name")
    b = right.withColumn("_right_name", F.lower(right[f"`{right_on}`"]))
    return a.join(b, "_right_name").drop("_left_name", "_right_name")
