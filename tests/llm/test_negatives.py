import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillwork.llm import negatives
from rillwork.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """The contract, pair by pair. Rows are (vec_id, vector, label)."""
    taken = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        taken.append((vec_id, [math.floor(256 * float(x)) for x in vector], label))
    sizes = {len(v) for _, v, _ in taken}
    out = []
    for size in sizes:
        group = [t for t in taken if len(t[1]) == size]
        matrix = np.array([t[1] for t in group], object).reshape(len(group), size)
        for a, (anchor, _, label) in enumerate(group):
            if anchor is None or anchor % 100:
                continue
            score = [int(x) for x in matrix @ matrix[a]] if size else [0] * len(group)
            order = sorted((i for i in range(len(group)) if i != a), key=lambda i: (-score[i], group[i][0] is None, group[i][0] or 0))
            for p in [i for i in order if group[i][2] == label][:5]:
                fits = [i for i in order if group[i][2] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
                out += [(anchor, group[p][0], rank, group[i][0], score[p], score[i]) for rank, i in enumerate(fits[:5], 1)]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query_by_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = got(QUERIES["op12_rotated_codes"](spark, sf_dir))
    assert found and found == brute(rows)


def clustered(n, size, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    vectors = centres[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, size))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return [(i * 10, vectors[i].astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def test_many_blocks(spark, monkeypatch):
    """Blocks of few rows, so that anchors and rows meet in many of them."""
    rows = clustered(900, 24)
    monkeypatch.setattr(negatives, "ROWS", 128)
    monkeypatch.setattr(negatives, "ANCHORS", 32)
    found = got(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)))
    assert len(found) > 300 and found == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(0, 2**32), st.sampled_from([1.0, 100.0, 0.0]))
def test_intervals_hold_the_scores(size, seed, scale):
    rng = np.random.default_rng(seed)
    ints = np.floor(rng.normal(size=(40, size)) * scale * 256).astype(np.int64)
    ints[:3] = ints[3:6]  # copies are the tightest case
    ints[6] = -ints[7]
    code, align = negatives.encode(ints)
    all_of = negatives.Coded(ints.astype(float), code, align, np.sqrt((ints.astype(float) ** 2).sum(axis=1)))
    low, high = negatives.intervals(all_of, all_of)
    exact = ints @ ints.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (negatives.scores(all_of, all_of) == exact).all()


def test_intervals_drop_unlike_pairs():
    rows = np.floor(256 * np.array([r[1] for r in clustered(600, 64)])).astype(np.int64)
    code, align = negatives.encode(rows)
    all_of = negatives.Coded(rows.astype(float), code, align, np.sqrt((rows.astype(float) ** 2).sum(axis=1)))
    _, high = negatives.intervals(all_of[:60], all_of)
    assert (high < 0.75 * 256 * 256).mean() > 0.7


def test_large_integers_are_exact():
    ints = np.array([[(1 << 26) - 1, 3, 5], [(1 << 26) - 3, 1, 1]])
    code, align = negatives.encode(ints)
    all_of = negatives.Coded(ints.astype(float), code, align, np.sqrt((ints.astype(float) ** 2).sum(axis=1)))
    assert negatives.scores(all_of, all_of).tolist() == (ints.astype(object) @ ints.T.astype(object)).tolist()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (100, [0.5, 0.5], 2), (100, None, 2), (200, [nan, 1.0], 2), (300, [1.0, None], 2), (400, [inf, 0.0], 1),
            (500, [0.0, 0.0], 1), (600, [1.0, 0.0], None), (None, [0.5, 0.25], 1), (None, [0.5, 0.5], 3), (5, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (700, [1.0], 3),
            (701, [1.0], 3), (800, [], 4), (801, [], 4), (802, [], 5), (900, [0.25, -0.5], 1), (901, [0.4, 0.4], 2), (902, [-0.5, -0.5], 2), (7, [0.45, 0.5], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS uid", "1 AS score", "2 AS rank", "'y' AS size")
    found = got(negatives.hard_negatives(df))
    assert found == brute(rows) and any(r[3] is None for r in found) and any(r[0] == 800 for r in found)
    assert got(negatives.hard_negatives(df.filter("false"))) == []


def test_large_numbers_beside_nulls(spark):
    base = 2**60 - 2**60 % 700
    rows = [(base, [0.5, 0.5], 1), (None, [0.5, 0.5], 2), (base + 1, [0.5, 0.5], 2), (base + 3, [0.5, 0.5], 2), (base + 5, [0.5, 0.4], 3)]
    assert got(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).coalesce(1))) == brute(rows)
