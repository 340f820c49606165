import random

import pytest

from rillwork.functions.text import score
from rillwork.operators import similarity
from rillwork.plans.matching import match_tables
from tests.conftest import rows


def brute(left, right, threshold):
    names = [{x.lower() for x in side if x is not None} for side in (left, right)]
    return sorted((a, b, score(a, b)) for a in names[0] for b in names[1] if score(a, b) > threshold)


def tables(spark, left, right):
    return spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")


def edited(rng, name):
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(name) + 1)
        name = rng.choice([name[:i] + rng.choice("abé#1") + name[i:], name[:i] + name[i + 1 :], name[:i][::-1] + name[i:], name + name[:i]])
    return name


@pytest.mark.parametrize("threshold, q", [(96, None), (96, 3), (85, None), (70, None), (70, 1), (40, None), (0, None)])
def test_every_pair_above_the_threshold(spark, threshold, q):
    rng = random.Random(threshold)
    words = ["".join(rng.choice("abcd ") for _ in range(rng.choice([1, 2, 4, 8, 16, 30]))) for _ in range(60)]
    left = words + ["", None, "ÉCOLE de la", "x" * 30, "xy" * 15, "a", "aaaa"]
    right = [edited(rng, w) for w in words for _ in range(2)] + ["", None, "école de l a", "x" * 29, "yx" * 15, "aaa", "a" * 5]
    got = rows(similarity.similar_names(*tables(spark, left, right), "a", "b", threshold, q))
    assert got == brute(left, right, threshold)


def test_hot_grams_are_split(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HOT", 5)
    left, right = [f"customer number {i:03}" for i in range(150)], [f"customer  number {i:03}" for i in range(0, 150, 7)]
    assert rows(similarity.similar_names(*tables(spark, left, right), "a", "b", 95)) == brute(left, right, 95)


def test_few_pairs_are_measured(spark):
    """Of a million pairs only those that may pass reach Python."""
    rng = random.Random(5)
    left = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(24)) for _ in range(1000)]
    a, b = tables(spark, left, [edited(rng, x) for x in left])
    bounds = similarity.Bounds(96)
    names = [df.selectExpr(f"{c} AS name", f"char_length({c}) AS size") for df, c in ((a, "a"), (b, "b"))]
    assert similarity.candidates(*names, bounds, 2).count() < 5000


def test_wrong_arguments(spark):
    with pytest.raises(ValueError):
        similarity.similar_names(*tables(spark, ["a"], ["a"]), "a", "b", 100)
    with pytest.raises(ValueError):
        similarity.similar_names(*tables(spark, ["a"], ["a"]), "a", "b", 40, q=2)
    assert similarity.similar_names(*tables(spark, [], []), "a", "b", 90).count() == 0


def test_rows_and_best_matches(spark):
    asked = spark.createDataFrame([(1, "Jane Austen"), (2, "J. R. R. Tolkien"), (3, "Nobody at all"), (4, None)], "id long, asked string")
    authors = spark.createDataFrame([("k1", "Jane Austin"), ("k2", "jane austen"), ("k3", "J.R.R. Tolkien"), ("k0", "Jane Austen")], "key string, name string")
    joined = similarity.join_similar(asked, authors, "asked", "name", 85)
    assert rows(joined, "id", "key") == [(1, "k0"), (1, "k1"), (1, "k2"), (2, "k3")]
    books = spark.createDataFrame([("k0", 1), ("k0", 2), ("k3", 3), ("k9", 4)], "author string, book long")
    out = match_tables(asked, authors, "asked", "name", "key", books, "author", ["book"], threshold=85, limit=1)
    assert rows(out["valid"], "id", "key", "score") == [(1, "k0", 100), (2, "k3", 93)]
    assert rows(out["error"].filter("asked IS NOT NULL"), "id") == [(3,)] and out["error"].count() == 2
    assert rows(out["works"], "key", "book") == [("k0", 2), ("k3", 3)]
