from itertools import product

import numpy as np
from pyspark.sql import functions as F

from rillwork.llm import hilbert

SCHEMA = "vec_id long, embedding array<float>, rank int"


def test_curve_visits_each_cell_once_and_moves_by_one_step():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(product(range(1 << bits), repeat=n)))
        place = hilbert.hilbert_index(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def plain(rows, k, step):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = list({(i, v.tobytes()): (i, v) for i, v in good}.values())
    out = {}
    for i, q in good:
        if i % step == 0:
            near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in good if j != i and len(v) == len(q))
            out[i] = [(r + 1, j, s) for r, (s, j) in enumerate(near[:k])]
    return out


def found(spark, rows, k, step):
    got = {}
    for r in hilbert.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % step == 0, k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_odd_rows_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(rng.integers(0, 3, 4)).tolist(), 1) for i in range(300)] + [(i, [1.0, 1.0, 1.0, 1.0], 1) for i in range(300, 340)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 4, 1), (403, [1.0, None, 1.0, 1.0], 1), (404, [float("nan")] * 4, 1), (405, [float("inf"), 1.0, 1.0, 1.0], 1)]
    rows += [(None, [1.0, 1.0, 1.0, 1.0], 1), (300, [1.0, 1.0, 1.0, 1.0], 1), (410, [1.0, 2.0], 1), (411, [1.0, 2.5], 1), (420, [5.0, 5.0, 5.0], 1)]
    got, want = found(spark, rows, 10, 10), plain(rows, 10, 10)
    assert set(got) == {q for q, v in want.items() if v}
    for q, v in got.items():
        assert [x[:2] for x in v] == [x[:2] for x in want[q]]
        assert np.allclose([x[2] for x in v], [x[2] for x in want[q]], atol=1e-12)
    assert hilbert.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", F.lit(1).alias("rank")).collect()
    rows = [tuple(r) for r in rows]
    got, want = found(spark, rows, 10, 50), plain(rows, 10, 50)
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_recall_when_windows_prune(spark, monkeypatch):
    """Slots of 32 vectors: more than 60 slots, and a window that leaves most of them out."""
    monkeypatch.setattr(hilbert, "SLOT", 32)
    seen = []
    window = hilbert.measured_window
    monkeypatch.setattr(hilbert, "measured_window", lambda *a: seen.append(window(*a)) or seen[-1])
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24))
    vectors = centres[rng.integers(0, 60, 2400)] + 0.1 * rng.normal(size=(2400, 24))
    rows = [(i, np.float32(v).tolist(), 1) for i, v in enumerate(vectors)]
    got, want = found(spark, rows, 10, 40), plain(rows, 10, 40)
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert 2 * seen[0] + 1 < 40 and hits >= 0.9 * sum(map(len, want.values()))
