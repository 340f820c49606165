"""Hard negatives by rotated one-bit codes.

Vectors become integers; their inner products are exact. Each is turned by one random rotation and stored as the signs of
its turned components, one bit each, with the alignment: its inner product with the unit vector that has these signs.
A vector is its alignment times that code vector and a rest at right angles to it, whose length is known.

An anchor is turned likewise and kept with six bits a component, so its inner product with a code vector is a sum of
popcounts, up to a known error. With that product s, the alignment a, the length r of the rest and the anchor's length q,
the inner product lies in a*s +- r*sqrt(q*q - s*s) by the Cauchy-Schwarz inequality: no odds, no misses. Candidates whose
interval cannot matter are dropped; the others are scored in integers.

Anchors and rows meet in blocks, dealt to tasks by the numbers of both blocks; a task gives the few best candidates of
each anchor, whatever the data. Labels play no part in the dealing, so a label that holds a third of all rows is no
heavier than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.llm.common import groups_of, starts_of
from rillwork.session import settle

# Fixed values of the contract.
SCALE, POSITIVES, NEGATIVES = 256, 5, 5
LEAST_PERCENT, MOST_PERCENT = 80, 100
#: Anchors and rows in a block, and anchors that a task handles at once.
ANCHORS, ROWS, TILE = 2048, 4096, 64
#: Bits of an anchor's turned components.
BITS = 6
SEED = 12
#: Integer vectors must be shorter than this, so that 100 times a score is a long.
LONGEST = float(1 << 27)

CODED = "uid bigint, vec_id bigint, known boolean, label bigint, size int, ints binary, code binary, align double"
SCORED = "uid bigint, wanted bigint, vec_id bigint, known boolean, score bigint"


@cache
def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    size = bits.shape[1]
    return np.packbits(np.pad(bits, ((0, 0), (0, -size % 64))), axis=1).view(np.uint64).reshape(len(bits), -(-size // 64))


@dataclass
class Coded:
    """Vectors of one size with their codes."""

    ints: np.ndarray
    code: np.ndarray
    align: np.ndarray
    norm: np.ndarray

    def __getitem__(self, rows) -> Coded:
        return Coded(self.ints[rows], self.code[rows], self.align[rows], self.norm[rows])


def encode(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and alignments of integer vectors."""
    turned = ints.astype(float) @ rotation(ints.shape[1]).T
    return packed(turned >= 0), np.abs(turned).sum(axis=1) / np.sqrt(max(1, ints.shape[1]))


def coded(group: pd.DataFrame) -> Coded:
    size, n = int(group["size"].iloc[0]), len(group)
    ints = np.frombuffer(b"".join(group["ints"]), np.int32).reshape(n, size).astype(float)
    code = np.frombuffer(b"".join(group["code"]), np.uint64).reshape(n, -(-size // 64))
    return Coded(ints, code, group["align"].to_numpy(), np.sqrt((ints * ints).sum(axis=1)))


def intervals(anchors: Coded, rows: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products, anchors by rows."""
    size = anchors.ints.shape[1]
    turned = anchors.ints @ rotation(size).T
    least = turned.min(axis=1, initial=0.0)
    step = np.maximum((turned.max(axis=1, initial=0.0) - least) / ((1 << BITS) - 1), 1e-9)
    levels = np.rint((turned - least[:, None]) / step[:, None]).astype(np.int64)
    error = np.sqrt(((turned - least[:, None] - step[:, None] * levels) ** 2).sum(axis=1))

    sums = np.zeros((len(anchors.ints), len(rows.ints)), np.int32)
    for b in range(BITS):
        plane = packed((levels >> b) & 1 == 1)
        for w in range(plane.shape[1]):
            sums += np.bitwise_count(plane[:, w, None] & rows.code[None, :, w]).astype(np.int32) << b
    ones = np.bitwise_count(rows.code).sum(axis=1, dtype=np.int64)
    signed = step[:, None] * (2 * sums - levels.sum(axis=1)[:, None]) + least[:, None] * (2 * ones - size)
    s = signed / np.sqrt(max(1, size))

    q, o, a = anchors.norm[:, None], rows.norm[None, :], rows.align[None, :]
    rest = np.sqrt(np.maximum(o * o - a * a, 0))
    peak = q * a / np.maximum(o, 1e-9)  # a*s + rest*sqrt(q*q - s*s) grows with s up to here
    near = np.clip(np.minimum(s + error[:, None], peak), -q, q)
    far = np.clip(np.maximum(s - error[:, None], -peak), -q, q)
    slack = 1e-9 * q * o + 1e-6
    return a * far - rest * np.sqrt(np.maximum(q * q - far * far, 0)) - slack, a * near + rest * np.sqrt(np.maximum(q * q - near * near, 0)) + slack


def scores(anchors: Coded, rows: Coded) -> np.ndarray:
    """Exact inner products. Sums below 2**53 are exact in floating point, larger ones are taken in integers."""
    if anchors.norm.max(initial=0.0) * rows.norm.max(initial=0.0) < 2.0**52:
        return (anchors.ints @ rows.ints.T).astype(np.int64)
    return anchors.ints.astype(np.int64) @ rows.ints.astype(np.int64).T


def first_of(values: np.ndarray, ids: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` of the places, larger values first, then smaller ids."""
    if len(places) > n:
        places = places[values[places] >= np.partition(values[places], -n)[-n]]
    return places[np.lexsort((ids[places], -values[places]))][:n]


def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for size, group in batch.groupby("size", sort=False):
            ints = np.concatenate([*group["ints"], np.zeros(0, np.int64)]).astype(np.int64).reshape(len(group), int(size))
            if (np.sqrt((ints.astype(float) ** 2).sum(axis=1)) >= LONGEST).any():
                raise ValueError("vectors are too long for integer scores")
            code, align = encode(ints)
            yield group.assign(ints=[x.tobytes() for x in ints.astype(np.int32)], code=[x.tobytes() for x in code], align=align)


def results(uid: int, wanted: int, group: pd.DataFrame, chosen: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    picked = group.iloc[chosen]
    return pd.DataFrame({"uid": uid, "wanted": wanted, "vec_id": picked["vec_id"].to_numpy(), "known": picked["known"].to_numpy(), "score": values[chosen]})


def best_same(left: pd.DataFrame, right: pd.DataFrame, n: int) -> Iterator[pd.DataFrame]:
    """The first ``n`` rows with the label of each anchor, the anchor itself left out."""
    for label in np.intersect1d(left["label"], right["label"]):
        own, others = left[left["label"] == label], right[right["label"] == label]
        anchors, rows, uids, ids = coded(own), coded(others), others["uid"].to_numpy(), others["vec_id"].to_numpy()
        for at in range(0, len(own), TILE):
            part, me = anchors[at : at + TILE], own["uid"].to_numpy()[at : at + TILE]
            low, high = intervals(part, rows)
            itself = uids[None, :] == me[:, None]
            low[itself], high[itself] = -np.inf, -np.inf
            # The n-th lower bound: what cannot reach it is not among the first n.
            floor = np.partition(low, -n, axis=1)[:, -n] if len(others) > n else np.full(len(me), -np.inf)
            open_pairs = (high >= floor[:, None]) & ~itself
            used = np.flatnonzero(open_pairs.any(axis=0))
            exact = scores(part, rows[used])
            for k, uid in enumerate(me):
                chosen = first_of(exact[k], ids[used], np.flatnonzero(open_pairs[k, used]), n)
                if len(chosen):
                    yield results(uid, 0, others.iloc[used], chosen, exact[k])


def best_other(left: pd.DataFrame, right: pd.DataFrame, n: int, least: int, most: int) -> Iterator[pd.DataFrame]:
    """For each anchor and wanted score, the first ``n`` rows of other labels from ``least`` to ``most`` percent of it."""
    anchors, rows, ids = coded(left), coded(right), right["vec_id"].to_numpy()
    labels, wanted = left["label"].to_numpy(), [np.frombuffer(w, np.int64) for w in left["wanted"]]
    lowest, highest = np.array([w.min() * least / 100 for w in wanted]), np.array([w.max() * most / 100 for w in wanted])
    order = np.argsort(lowest, kind="stable")  # anchors with like limits leave like rows
    for at in range(0, len(left), TILE):
        tile = order[at : at + TILE]
        low, high = intervals(anchors[tile], rows)
        open_pairs = (high >= lowest[tile, None]) & (low <= highest[tile, None]) & (labels[tile, None] != right["label"].to_numpy()[None, :])
        used = np.flatnonzero(open_pairs.any(axis=0))
        if not len(used):
            continue
        exact, others, names = scores(anchors[tile], rows[used]), right.iloc[used], ids[used]
        for k, anchor in enumerate(tile):
            for score in np.unique(wanted[anchor]):
                fits = open_pairs[k, used] & (100 * exact[k] >= least * score) & (100 * exact[k] <= most * score)
                chosen = first_of(exact[k], names, np.flatnonzero(fits), n)
                if len(chosen):
                    yield results(left["uid"].iloc[anchor], score, others, chosen, exact[k])


def meet(batches: Iterator[pd.DataFrame], find) -> Iterator[pd.DataFrame]:
    """Each pair of blocks: the anchors (side 0) and the rows (side 1)."""
    keys = ["size", "i", "j"]
    for frame in groups_of(batches, keys):
        starts = starts_of(*[frame[c].to_numpy() for c in keys])
        for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
            group = frame.iloc[a:b]
            left, right = (group[group["side"] == s] for s in (0, 1))
            found = list(find(left, right)) if len(left) and len(right) else []
            if found:
                yield pd.concat(found, ignore_index=True)


def dealt(anchors: DataFrame, rows: DataFrame, find) -> DataFrame:
    """What ``find`` gives for every block of anchors beside every block of rows of the same size."""
    spark = rows.sparkSession
    sizes = rows.groupBy("size").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("n_rows"))
    sizes = sizes.join(anchors.groupBy("size").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("n_anchors")), "size")
    sizes = settle(sizes, "blocks")
    blocks = sizes.agg(F.sum(F.col("n_rows").cast("long") * F.col("n_anchors"))).first()[0] or 1

    def placed(df: DataFrame, side: int, own: str, other: str, into: tuple[str, str]) -> DataFrame:
        at, every = F.pmod(F.xxhash64("uid"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return df.join(sizes, "size").select(*df.columns, F.lit(side).alias("side"), at.alias(into[0]), every.alias(into[1]))

    every = placed(anchors, 0, "n_anchors", "n_rows", ("i", "j")).unionByName(placed(rows, 1, "n_rows", "n_anchors", ("j", "i")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 16)
    return every.repartition(parts, "size", "i", "j").sortWithinPartitions("size", "i", "j").mapInPandas(partial(meet, find=find), SCORED)


def first_rows(found: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each anchor and wanted score, of all blocks, with their rank."""
    order = Window.partitionBy("uid", "wanted").orderBy(F.desc("score"), F.desc("known"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def usable(vector: Column) -> Column:
    """Not null, and all components finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PERCENT, most: int = MOST_PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows of (vec_id, label, embedding).

    An anchor's positives are its first rows of the same label by integer inner product, ties by smaller vec_id; a
    positive's negatives the first rows of other labels that score from ``least`` to ``most`` percent of the positive's.

    Rows with a null label or vector, or a component that is null or not finite, take no part; zero vectors do, and score
    0. Vectors of different sizes never meet. A row with a null vec_id is no anchor; as a candidate it comes after others of its
    score. Repeated rows are rows of their own: each anchor row has its own results, and a copy of an anchor may be its
    positive. Anchors without positives, positives without negatives and empty tables have no rows. Vectors whose
    integers are as long as 2**27 are an error.
    """
    vector = F.col("embedding").cast("array<double>")
    ints = F.transform(vector, lambda x: F.floor(x * float(SCALE)))
    taken = rows.filter(F.col("label").isNotNull() & usable(vector))
    taken = taken.select(
        F.monotonically_increasing_id().alias("uid"), F.coalesce("vec_id", F.lit((1 << 63) - 1)).alias("vec_id"), F.col("vec_id").isNotNull().alias("known"),
        F.col("label").cast("long").alias("label"), F.size("embedding").alias("size"), ints.alias("ints"), F.lit(b"").alias("code"), F.lit(0.0).alias("align"),
    )
    codes = settle(taken.mapInPandas(index, CODED), "codes").withColumn("wanted", F.lit(b""))
    anchors = codes.filter(F.col("known") & is_anchor)

    same = dealt(anchors, codes, partial(best_same, n=positives))
    same = settle(first_rows(same, positives), "positives").select("uid", F.col("vec_id").alias("positive"), F.col("known").alias("named"), F.col("score").alias("wanted"))
    # Below zero 80 percent of a score is more than the score: nothing fits.
    wanted = same.filter("wanted >= 0").groupBy("uid").agg(F.collect_set("wanted").alias("scores"))
    bounded = anchors.drop("wanted").join(wanted, "uid").withColumn("wanted", longs(F.col("scores"))).drop("scores")
    other = dealt(settle(bounded, "bounded"), codes, partial(best_other, n=negatives, least=least, most=most))
    other = first_rows(other, negatives)

    named = anchors.select("uid", F.col("vec_id").alias("anchor_id"))
    return same.join(other, ["uid", "wanted"]).join(named, "uid").select(
        "anchor_id", F.when(F.col("named"), F.col("positive")).alias("positive_id"), "rank",
        F.when(F.col("known"), F.col("vec_id")).alias("negative_id"), F.col("wanted").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def longs(values: Column) -> Column:
    """A few longs as little-endian bytes."""
    hexes = F.transform(values, lambda x: F.lpad(F.hex(x), 16, "0"))
    little = F.transform(hexes, lambda h: F.array_join(F.transform(F.sequence(F.lit(15), F.lit(1), F.lit(-2)), lambda i: F.substring(h, i, F.lit(2))), ""))
    return F.unhex(F.array_join(little, ""))


def hard_negatives(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``mine`` with the labels of every seventh vec_id moved on by one, modulo 10, and every hundredth vec_id as an
    anchor. Other columns are not read."""
    own = df.select(df[f"`{vec_id}`"].cast("long").alias("vec_id"), df[f"`{embedding}`"].alias("embedding"), df[f"`{label}`"].cast("long").alias("label"))
    moved = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(own.withColumn("label", moved), F.col("vec_id") % 100 == 0)
