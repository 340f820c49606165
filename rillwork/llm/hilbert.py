"""Nearest neighbours from several shifted Hilbert orderings of projected vectors.

Each ordering projects the vectors to a few dimensions in its own random way, shifts them, and numbers the cells of a
grid along a Hilbert curve. Near vectors tend to be near on some of the curves. The orderings are cut into slots at
sampled quantiles and range-partitioned by Spark; a query is sent to the slots of a window around its own place on every
curve, each slot gives its best candidates by exact distance, and the windows' candidates are merged and ranked again.

How wide the window must be depends on the data. It is measured: for a bounded number of queries the true neighbours are
found among all rows, and the window is made as wide as the target recall asks for on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.llm.common import groups_of, map_frames, sampled_share, starts_of
from rillwork.llm.covertree import usable
from rillwork.session import settle

CURVES, DIMENSIONS, BITS, TIE_BITS = 4, 8, 6, 14
#: Vectors that the orderings are fitted on, at most so many bytes; queries that the window is measured on.
SAMPLE, SAMPLE_BYTES, MEASURED = 8192, 32 << 20, 64
#: Distinct vectors in a slot, about. Share of the measured neighbours that the windows must hold.
SLOT, RECALL = 1024, 0.97


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of coordinates below 2**bits) on the Hilbert curve, by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b) & 1
    return out


def tie_breaks(nodes: np.ndarray) -> np.ndarray:
    return ((nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TIE_BITS)).astype(np.int64)


@dataclass
class Ordering:
    """One curve over vectors of one length: projection, grid, and the keys at which slots begin."""

    axes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    cuts: np.ndarray

    def keys(self, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Place on the curve; vectors of one cell are told apart by their number, so that no slot can overflow."""
        cells = np.clip((rows @ self.axes - self.low) / self.step, 0, (1 << BITS) - 1).astype(np.int64)
        return hilbert_index(cells, BITS) << TIE_BITS | tie_breaks(nodes)

    def slots(self, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, self.keys(rows, nodes), "right")


def fit(rows: np.ndarray, nodes: np.ndarray, slots: int, seed: int) -> Ordering:
    random = np.random.default_rng([seed, rows.shape[1]])
    wide = min(DIMENSIONS, rows.shape[1])
    axes = np.linalg.qr(random.standard_normal((rows.shape[1], wide)))[0]
    seen = rows @ axes
    low, high = np.quantile(seen, 0.001, axis=0), np.quantile(seen, 0.999, axis=0)
    step = np.maximum((high - low) / ((1 << BITS) - 2), 1e-300)
    low = low - step * random.random(wide) * 2  # the shift
    own = Ordering(axes, low, step, np.zeros(0, np.int64))
    keys = np.sort(own.keys(rows, nodes))
    own.cuts = np.unique(keys[(np.arange(1, slots) * len(keys)) // slots]) if len(keys) else own.cuts
    return own


POINTS = "node bigint, first bigint, size int, vector binary, slots array<int>"
BEST = "query_id bigint, size int, nodes array<bigint>, firsts array<bigint>, scores array<double>"


def best(queries: np.ndarray, points: np.ndarray, firsts: np.ndarray, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places of its ``keep`` nearest points, ties to the smaller first id, and their distances."""
    out = []
    for a in range(0, len(queries), 256):
        some = queries[a : a + 256]
        rough = (some**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * some @ points.T
        slack = 1e-12 * (1 + np.abs(rough).max())
        limit = np.partition(rough, min(keep, len(points)) - 1, axis=1)[:, min(keep, len(points)) - 1]
        for q, row, most in zip(some, rough, limit, strict=True):
            near = np.flatnonzero(row <= most + slack)
            exact = np.sqrt(((points[near] - q) ** 2).sum(axis=1))
            order = np.lexsort((firsts[near], exact))[:keep]
            out.append((near[order], exact[order]))
    return out


def merged(batches: Iterator[pd.DataFrame], keep: int) -> Iterator[pd.DataFrame]:
    """The ``keep`` best of each query from rows that are sorted by query."""
    for frame in groups_of(batches, ["query_id", "size"]):
        starts = starts_of(frame["query_id"].to_numpy(), frame["size"].to_numpy())
        for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
            part = frame.iloc[a:b]
            node, first, score = (np.concatenate([np.asarray(x) for x in part[c]]) for c in ("nodes", "firsts", "scores"))
            _, alone = np.unique(node, return_index=True)  # several curves may have found it
            order = alone[np.lexsort((first[alone], score[alone]))][:keep]
            yield pd.DataFrame({
                "query_id": [part["query_id"].iloc[0]], "size": [part["size"].iloc[0]],
                "nodes": [node[order]], "firsts": [first[order]], "scores": [score[order]],
            })


def found_by(query_ids, size: int, nodes: np.ndarray, firsts: np.ndarray, found: list) -> pd.DataFrame:
    """What ``best`` found for these queries, as rows."""
    places, scores = [p for p, _ in found], [s for _, s in found]
    return pd.DataFrame({"query_id": query_ids, "size": size, "nodes": [nodes[p] for p in places], "firsts": [firsts[p] for p in places], "scores": scores})


def matrix(binary) -> np.ndarray:
    return np.frombuffer(b"".join(binary), np.float64).reshape(len(binary), -1)


def nearest(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows nearest to each query row by Euclidean distance, ties to the
    smaller vec_id, the query itself left out. ``is_query`` is over the column vec_id.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without vec_id, take no part;
    vectors of different lengths are not compared. Equal vectors are searched as one and listed one by one. Rows that
    repeat a vec_id and its vector count once. Other columns are not read. With fewer than ``k`` others all are returned.
    """
    spark, keep = df.sparkSession, k + 6
    rows = df.select(df[f"`{vec_id}`"].cast("long").alias("vec_id"), df[f"`{embedding}`"].cast("array<double>").alias("embedding"))
    rows = rows.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    # Of equal vectors only the smallest ids can be among k neighbours; each task keeps these few before the shuffle.
    order = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.distinct().withColumn("place", order).filter(F.col("place") <= k + 1)
    points = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = settle(points.withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("embedding")), "points")
    stats = points.agg(F.count("*").alias("n"), F.max("size").alias("size")).first()
    bound = min(SAMPLE, SAMPLE_BYTES // (8 * max(1, stats.size or 1)))
    sample: dict[int, list] = {}
    picked = points.filter(sampled_share(F.col("node"), 9) < bound / max(1, stats.n)).select("size", "node", "embedding")
    for row in sorted(picked.collect(), key=lambda r: r.node):
        sample.setdefault(row.size, []).append((row.node, row.embedding))
    orderings = {}
    for size, got in sorted(sample.items()):
        nodes, data = np.array([x[0] for x in got]), np.array([x[1] for x in got])
        slots = max(1, min(len(got), round(stats.n * len(got) / sum(map(len, sample.values())) / SLOT)))
        orderings[size] = [fit(data, nodes, slots, c) for c in range(CURVES)]
    shared = spark.sparkContext.broadcast(orderings)  # bounded by the sample

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, group in batch.groupby("size", sort=False):
                data, nodes = np.array(group["embedding"].tolist(), np.float64), group["node"].to_numpy()
                curves = shared.value.get(size)
                slots = np.stack([c.slots(data, nodes) for c in curves], axis=1) if curves else np.zeros((len(group), CURVES), np.int64)
                firsts, vectors = [x[0] for x in group["ids"]], [x.tobytes() for x in data]
                yield pd.DataFrame({"node": nodes, "first": firsts, "size": size, "vector": vectors, "slots": list(slots)})

    placed = settle(points.mapInPandas(place, POINTS), "placed")
    asked = rows.filter(is_query).distinct().join(points.select("embedding", "node"), "embedding").select(F.col("vec_id").alias("query_id"), "node")
    asked = settle(asked.join(placed.drop("first"), "node"), "asked")
    window = measured_window(asked, placed, keep, k, recall)

    # Every point on every curve, every query in every slot of its windows; ranges of slots go to one task.
    curves = F.posexplode("slots").alias("curve", "slot")
    held = placed.select(curves, F.lit(None).cast("long").alias("query_id"), "node", "first", "size", "vector")
    at = asked.select("query_id", F.posexplode("slots").alias("curve", "at"), "node", "size", "vector")
    spans = F.explode(F.sequence(F.greatest(F.col("at") - window, F.lit(0)), F.col("at") + window)).alias("slot")
    sent = at.select("curve", spans, "query_id", "node", F.lit(0).cast("long").alias("first"), "size", "vector")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["size", "curve", "slot"]
        for frame in groups_of(batches, keys):
            starts = starts_of(*[frame[c].to_numpy() for c in keys])
            for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
                group = frame.iloc[a:b]
                is_point = group["query_id"].isna().to_numpy()
                if is_point.all() or not is_point.any():
                    continue
                own, ask = group[is_point], group[~is_point]
                nodes, firsts = own["node"].to_numpy(), own["first"].to_numpy()
                found = best(matrix(ask["vector"]), matrix(own["vector"]), firsts, keep)
                yield found_by(ask["query_id"].to_numpy(np.int64), group["size"].iloc[0], nodes, firsts, found)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(held.unionByName(sent), "windows").repartitionByRange(parts, "size", "curve", "slot").sortWithinPartitions("size", "curve", "slot")
    some = map_frames(dealt, search, BEST)
    final = some.repartition(parts, "query_id").sortWithinPartitions("query_id", "size").mapInPandas(lambda b: merged(b, keep), BEST)
    pairs = final.select("query_id", F.explode(F.arrays_zip("nodes", "scores")).alias("x"))
    pairs = settle(pairs.select("query_id", F.col("x.nodes").alias("node"), F.col("x.scores").alias("score")), "pairs")
    listed = pairs.join(points.select("node", "ids"), "node").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    once = listed.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def measured_window(asked: DataFrame, placed: DataFrame, keep: int, k: int, recall: float) -> int:
    """Slots on each side of a query that hold the share ``recall`` of true neighbours on their best curve, measured on
    about ``MEASURED`` queries against all points."""
    n = asked.count()
    some = asked.filter(sampled_share(F.col("query_id"), 10) < MEASURED / max(1, n)).collect() if n else []
    if not some:
        return 1
    shared = asked.sparkSession.sparkContext.broadcast(some)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, group in batch.groupby("size", sort=False):
                own = [r for r in shared.value if r["size"] == size]
                if own:
                    nodes, firsts = group["node"].to_numpy(), group["first"].to_numpy()
                    found = best(matrix([r.vector for r in own]), matrix(group["vector"]), firsts, keep)
                    yield found_by([r.query_id for r in own], size, nodes, firsts, found)

    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    truth = placed.mapInPandas(run, BEST).repartition(parts, "query_id").sortWithinPartitions("query_id", "size").mapInPandas(lambda b: merged(b, k + 1), BEST)
    pairs = truth.select("query_id", F.explode("nodes").alias("node")).join(placed.select("node", "slots"), "node").collect()
    own = {r.query_id: np.array(r.slots) for r in some}
    gaps = np.sort([np.abs(own[r.query_id] - np.array(r.slots)).min() for r in pairs])
    return max(1, int(gaps[min(len(gaps) - 1, int(np.ceil(recall * len(gaps))))])) if len(gaps) else 1
