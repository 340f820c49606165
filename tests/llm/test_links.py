"""Vector links, document groups, and the components that both rest on."""

import random
from collections import defaultdict

import numpy as np
import pytest

from rillwork.llm import chosen_path, components, covertree
from tests.llm.odd import ODD, no_docs, odd_docs


def roots(n, links):
    label = list(range(n))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(5, 5)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = dict(map(tuple, components.stars(spark.createDataFrame(links, "u long, v long")).collect()))
    want = roots(300, links)
    assert got == {i: r for i, r in enumerate(want) if r != i}
    assert components.stars(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_links(rows, threshold):
    good = [k for k, (i, v, lab, _) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for x, a in enumerate(good):
        for b in good[:x]:
            (_, v, la, _), (_, w, lb, _) = rows[a], rows[b]
            if la == lb and len(v) == len(w):
                v, w = np.array(v, float), np.array(w, float)
                if v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                    links.append((a, b))
    return links


@pytest.mark.parametrize("block", [5, 4096])
def test_vector_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, np.float32(rng.standard_normal(16)).tolist(), int(i % 3), 7) for i in range(150)]
    for c in range(6):  # balls of several widths, in one label or several
        centre = rng.standard_normal(16)
        rows += [(200 + 40 * c + j, np.float32((centre + rng.standard_normal(16) * 0.03 * (c + 1)) * rng.uniform(0.1, 9)).tolist(), c % 2, 7) for j in range(40)]
    rows += [(600 + j, rows[160][1], rows[160][2], None) for j in range(12)]
    rows += [(700, None, 1, 7), (701, [], 1, 7), (702, [0.0] * 16, 1, 7), (703, [float("nan")] * 16, 1, 7), (704, rows[160][1], None, 7), (705, [1.0, None], 1, 7),
             (706, [1.0, 2.0], 1, 7), (707, [2.0, 4.0], 1, 7), (None, rows[160][1], rows[160][2], 7), (200, rows[200][1], rows[200][2], 7)]
    links = plain_links(rows, 0.98)
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    label = roots(len(rows), links)
    least = {r: min((rows[k][0] for k in range(len(rows)) if label[k] == r and rows[k][0] is not None), default=None) for r in set(label)}
    want = sorted((str(rows[k][0]), count[k], least[label[k]], rows[k][0] == least[label[k]]) for k in range(len(rows)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node long")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in covertree.link_vectors(df, 0.98).collect())
    assert got == want and len(links) > 1000
    assert covertree.link_vectors(df.limit(0), 0.98).count() == 0


def shingles(text, n=5):
    words = (text or "").split()
    return frozenset(" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else None


def similar(a, b):
    shared = len(a & b)
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


@pytest.mark.parametrize("large", [4, 256])
def test_document_groups_against_all_pairs(spark, monkeypatch, large):
    monkeypatch.setattr(chosen_path, "LARGE", large)
    monkeypatch.setattr(chosen_path, "BLOCK", 16 if large == 4 else 1024)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows, passage = [], rng.choices(words, k=60)
    for g in range(14):
        base = rng.choices(words, k=rng.choice([6, 12, 40, 150, 400]))
        for _ in range(rng.choice([1, 3, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(base) // 20])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 20, " ".join(copy if g % 3 else [*copy, *passage]), "en", "s", 1, "x"))
    rows += ODD
    sets = [None if r[0] is None else shingles(r[1]) for r in rows]
    links = [(a, b) for a in range(len(rows)) if sets[a] for b in range(a) if sets[b] and similar(sets[a], sets[b])]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    label = roots(len(rows), links)
    least = {r: min((rows[k][0] for k in range(len(rows)) if label[k] == r and rows[k][0] is not None), default=None) for r in set(label)}
    want = sorted((str(rows[k][0]), least[label[k]], count[k]) for k in range(len(rows)))
    df = spark.createDataFrame(rows, odd_docs(spark).schema)
    got = chosen_path.jaccard_groups(df)
    assert sorted((str(r.doc_id), r.class_id, r.n_links) for r in got.collect()) == want and len(links) > 500
    kept = chosen_path.one_of_each_group(df).collect()
    groups = {label[k] for k in range(len(rows)) if sets[k]}
    assert sum(r.doc_id is not None and shingles(r.text) is not None for r in kept) == len(groups)
    assert sum(r.doc_id is None or shingles(r.text) is None for r in kept) == sum(s is None for s in sets)
    assert chosen_path.jaccard_groups(no_docs(spark)).count() == 0


def test_overlaps_are_exact():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60 if i % 2 else 3000, rng.integers(1, 90)).astype(np.uint64)) for i in range(60)]
    left, right = np.arange(0, 25), np.arange(20, 60)
    want = [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]
    got = chosen_path.overlaps(sets, left, right)
    same = left[:, None] == right[None, :]
    assert np.array_equal(np.where(same, 0, got), np.where(same, 0, want))


def test_small_sets_meet_in_split_buckets():
    rng = np.random.default_rng(5)
    for small, large in ((4, 5), (8, 10), (12, 15)):
        missed = 0
        for _ in range(1000):
            tokens = rng.integers(0, 1 << 63, large, dtype=np.uint64)
            a, b = (chosen_path.paths_of(np.sort(tokens[:n]), 0.8, 16)[2] for n in (small, large))
            missed += not set(a.tolist()) & set(b.tolist())
        assert not missed


def test_dual_traversal_visits_few_pairs_and_finds_all():
    rng = np.random.default_rng(9)
    centres = np.repeat(rng.normal(size=(12, 16)), 12, axis=0) + 0.25 * rng.normal(size=(144, 16))  # clusters of clusters
    rows = covertree.unit_rows(centres[rng.integers(0, 144, 3000)] + 0.02 * rng.normal(size=(3000, 16)))
    reach = float(np.sqrt(2 - 2 * 0.98))
    numbers = iter(range(10_000))
    forest = covertree.Forest({("a", 16): covertree.grow(rows, 2.0, reach / 2, numbers)}, {})
    forest.centres = {n.number: n.centre for n in covertree.flat(forest.trees["a", 16])}
    home, far = forest.home(("a", 16), rows)
    forest.radii = {int(k): float(far[home == k].max()) for k in np.unique(home)}
    met = {frozenset(p) for p in forest.meetings(("a", 16), reach)}
    used = len(forest.radii)
    assert used > 100 and forest.visits < 0.3 * used * (used - 1) / 2
    hits = np.argwhere(rows @ rows.T >= 0.98)
    assert all(home[a] == home[b] or frozenset((int(home[a]), int(home[b]))) in met for a, b in hits)
    # None but those that the own vectors' radii allow.
    for pair in met:
        a, b = pair
        gap = np.linalg.norm(forest.centres[a] - forest.centres[b])
        assert gap <= forest.radii[a] + forest.radii[b] + reach + 1e-6
