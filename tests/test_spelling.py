import random
from itertools import combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from rillwork.functions.blocks import scores
from rillwork.functions.text import score
from rillwork.operators import similarity, spelling
from tests.conftest import rows
from tests.test_similarity import brute, edited, tables


def test_scores_at_once_are_those_of_difflib():
    rng = random.Random(2)
    left = ["".join(rng.choice("ab c1é😀") for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["ab c" * 60, "A", "", "b"]
    right = [edited(rng, x) for x in left[:-3]] + ["a", "", "c"]
    assert scores(left, right).tolist() == [score(a, b) for a, b in zip(left, right)]
    assert scores([], []).tolist() == []


def test_no_pair_meets_twice():
    """Sums of up to four weights are all different."""
    sums = [sum(map(int, c)) % 2**64 for n in range(spelling.FEW + 1) for c in combinations_with_replacement(spelling.WEIGHTS, n)]
    assert len(set(sums)) == len(sums)


def test_names_of_few_words_meet_few_others(spark):
    """Names in which only digits tell thousands of others apart: by rare grams each met most of the others that share a word."""
    rng = random.Random(3)
    left = [f"{rng.choice(['large', 'small'])} {rng.choice(['ring', 'bolt'])} standard brand#{rng.randint(1, 9)} {i + 100000}" for i in range(0, 60000, 20)]
    right = [edited(rng, x) for x in left]
    bar = similarity.Bounds(94).bar
    sides = [df.select(F.col(c).alias("name")).distinct() for df, c in zip(tables(spark, left, right), "ab")]
    known = [spelling.marks(s, bar) for s in sides]
    a, b = (spelling.entries(s, other, bar).toDF("key", *[f"{x}_{c}" for c in ("taken", "out", "name")]) for s, other, x in ((sides[0], known[1], "a"), (sides[1], known[0], "b")))
    met = a.join(b, "key").filter(F.col("a_taken").bitwiseAND(F.col("b_taken")) == 0)
    assert met.count() < 100 * len(left)
    assert rows(similarity.similar_names(*tables(spark, left[:300], right[:300]), "a", "b", 94)) == brute(left[:300], right[:300], 94)


@pytest.mark.parametrize("hot", [5, 20_000])
def test_long_names_and_hot_grams(spark, monkeypatch, hot):
    """Beyond a few characters left over, pairs are found by grams, and those at the border by either way alone."""
    monkeypatch.setattr(similarity, "HOT", hot)
    rng = random.Random(4)
    left = ["".join(rng.choice("abcdef 12") for _ in range(rng.randint(30, 110))) for _ in range(80)]
    right = []
    for name in left:
        for _ in range(3):
            x = list(name)
            for _ in range(rng.randint(0, 5)):
                k = rng.randrange(len(x))
                x[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "2", "zz"])
            right.append("".join(x))
    assert rows(similarity.similar_names(*tables(spark, left, right), "a", "b", 94)) == brute(left, right, 94)


def test_many_names_of_the_same_characters(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HOT", 3)
    rng = random.Random(6)
    left = ["".join(rng.sample("aaabbb1234567 customer number", 29)) for _ in range(40)]
    right = [x[:k] + x[k + 1 :] + x[k] for x in left for k in (0, 5, 27)] + ["ж" + x[1:] for x in left] + [x + "жж" for x in left]
    assert rows(similarity.similar_names(*tables(spark, left, right), "a", "b", 95)) == brute(left, right, 95)
