"""Exact cosine links by a dual traversal of cover trees.

Per label a tree of nested levels with halving radii is laid over a bounded sample: a node's children are balls of half
its radius that hold enough of the sample, and vectors outside all of them stay with the node itself. Every vector goes
down the tree to its node. Distances of unit vectors obey the triangle inequality, so pairs of nodes whose covering
radii keep them too far apart are dropped with all pairs below them, and so are vectors too far from a node. Within a node, vectors so close to
its centre that they must be linked with all others there are counted without a comparison. Whatever is left is compared
exactly, in blocks that different tasks take on. Tasks return counts and spanning links, never all pairs.

What the tree saves depends on the data: vectors that form no balls stay in the top node and are compared block by
block, which is quadratic in a label's size; no vector is left out for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import groups_of, sampled_share, starts_of
from rillwork.llm.components import stars
from rillwork.session import settle

#: The trees are built from about this many vectors in all, and at most so many bytes.
SAMPLE, SAMPLE_BYTES = 4096, 32 << 20
#: Sampled vectors that make a ball a node; vectors in a block.
LEAST_SAMPLED, BLOCK = 4, 4096
#: Slack of all bounds against rounding: distances near 0 are off by up to 4e-8.
SLACK = 1e-7


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors) -> np.ndarray:
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@dataclass
class Node:
    number: int
    centre: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * rows @ centres.T
    return np.sqrt(np.maximum(square, 0))


def grow(rows: np.ndarray, radius: float, least_radius: float, numbers: Iterator[int]) -> Node:
    """A node over sampled rows, and its children at half the radius."""
    node = Node(next(numbers), rows.mean(axis=0), radius)
    half = radius / 2
    if half < least_radius or len(rows) < 2 * LEAST_SAMPLED:
        return node
    free = np.ones(len(rows), bool)
    for i in range(len(rows)):
        if not free[i]:
            continue
        near = free & (distances(rows, rows[i : i + 1])[:, 0] <= half)
        if near.sum() >= LEAST_SAMPLED:
            centre = rows[near].mean(axis=0)
            own = free & (distances(rows, centre[None])[:, 0] <= half)
            if own.sum() >= LEAST_SAMPLED:
                node.children.append(grow(rows[own], half, least_radius, numbers))
                free &= ~own
    return node


def descend(node: Node, rows: np.ndarray, index: np.ndarray, out: np.ndarray) -> None:
    """``out`` gets the number of the node that each row ends in."""
    out[index] = node.number
    if node.children and len(index):
        far = distances(rows[index], np.stack([c.centre for c in node.children]))
        best = far.argmin(axis=1)
        inside = far[np.arange(len(index)), best] <= node.radius / 2
        for k, child in enumerate(node.children):
            descend(child, rows, index[inside & (best == k)], out)


def flat(node: Node) -> list[Node]:
    return [node, *[x for c in node.children for x in flat(c)]]


@dataclass
class Forest:
    """Trees by (label, length of the vectors), and what the data showed about each node."""

    trees: dict[tuple[str, int], Node]
    centres: dict[int, np.ndarray]
    radii: dict[int, float] = field(default_factory=dict)
    visits: int = 0

    def home(self, key: tuple[str, int], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node and distance to its centre of each row; -1 and 0 where there is no tree."""
        out, far = np.full(len(rows), -1, np.int64), np.zeros(len(rows))
        if tree := self.trees.get(key):
            descend(tree, rows, np.arange(len(rows)), out)
            for k in np.unique(out):
                far[out == k] = distances(rows[out == k], self.centres[k][None])[:, 0]
        return out, far

    def hosts(self, key: tuple[str, int], reach: float) -> dict[int, list[int]]:
        """For each node the other nodes whose vectors it must be compared with there. A pair of nodes meets at the one with
        the smaller radius, where the bound for single vectors is sharper."""
        out: dict[int, list[int]] = {}
        for a, b in self.meetings(key, reach):
            if (self.radii[b], b) > (self.radii[a], a):
                a, b = b, a
            out.setdefault(a, []).append(b)
        return out

    def meetings(self, key: tuple[str, int], reach: float) -> list[tuple[int, int]]:
        """Pairs of different nodes of which vectors may be linked: the dual traversal from (root, root).

        A node covers its own vectors and all below it, within its covering radius. A pair of nodes whose covers are further
        apart than ``reach`` is dropped with everything below both; else the wider one of the two gives way to its children and
        to its own vectors, which are a child without children, until pairs of own vectors are left.
        """
        root, out, self.visits = covered(self.trees[key], self.radii), [], 0
        todo = [(root, root)] if root else []
        while todo:
            a, b = todo.pop()
            if a is b:
                parts = a.parts
                todo += [(p, p) for p in parts if p.parts]
                for k, part in enumerate(parts[:-1]):
                    self.visits += len(parts) - k - 1
                    todo += [(part, x) for x in apart(part, parts[k + 1 :], reach)]
            elif not a.parts and not b.parts:
                out.append((a.number, b.number))
            else:
                if not a.parts or (b.parts and b.cover > a.cover):
                    a, b = b, a
                self.visits += len(a.parts)
                todo += [(b, x) for x in apart(b, a.parts, reach)]
        return out


@dataclass
class Cover:
    """A node with its covering radius, or (without parts) the vectors of a node alone."""

    number: int
    centre: np.ndarray
    cover: float
    parts: list[Cover]


def covered(node: Node, radii: dict[int, float]) -> Cover | None:
    """The subtree with the radius that covers all vectors in it; None if there are none."""
    parts = [c for c in (covered(child, radii) for child in node.children) if c]
    if node.number in radii:
        parts.append(Cover(node.number, node.centre, radii[node.number], []))
    if not parts:
        return None
    far = distances(node.centre[None], np.stack([p.centre for p in parts]))[0]
    return Cover(node.number, node.centre, float((far + [p.cover for p in parts]).max()), parts)


def apart(one: Cover, others: list[Cover], reach: float) -> list[Cover]:
    """Those of the others whose cover comes within ``reach`` of the cover of ``one``."""
    gaps = distances(one.centre[None], np.stack([x.centre for x in others]))[0] - [x.cover for x in others] - one.cover
    return [x for x, gap in zip(others, gaps, strict=True) if gap <= reach + SLACK]


def plant(nodes: DataFrame, reach: float) -> Forest:
    """Trees over a sample of the distinct vectors (node, label, embedding, size)."""
    stats = nodes.agg(F.count("*").alias("n"), F.max("size").alias("size")).first()
    bound = min(SAMPLE, SAMPLE_BYTES // (8 * max(1, stats.size or 1)))
    rows = nodes.filter(sampled_share(F.col("node"), 8) < bound / max(1, stats.n)).select("label", "size", "embedding", "node").collect()
    groups: dict[tuple[str, int], list] = {}
    for row in sorted(rows, key=lambda r: r.node):
        groups.setdefault((row.label, row.size), []).append(row.embedding)
    numbers = iter(range(1 << 40))
    trees = {key: grow(unit_rows(v), 2.0, reach / 2, numbers) for key, v in sorted(groups.items())}
    return Forest(trees, {n.number: n.centre for t in trees.values() for n in flat(t)})


HOMES = "node bigint, label string, size int, copies bigint, unit binary, home bigint, far double"
FOUND = "node bigint, links bigint, root bigint"


def merge(labels: np.ndarray, hits: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
    """Give what ``hits`` (rows by columns) links one label, the smallest."""
    for x in np.flatnonzero(hits.any(axis=1)):
        own = labels[columns[hits[x]]]
        least, most = min(own.min(), labels[rows[x]]), max(own.max(), labels[rows[x]])
        if least != most:
            labels[np.isin(labels, np.append(own, labels[rows[x]]))] = least


def compare(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Each comparison (host, kind, i, j) of two blocks, or of one with itself: the number of linked copies of each
    node, and a node that it is joined to by links. Linear in the rows, whatever the number of links."""
    keys = ["host", "kind", "i", "j"]
    for frame in groups_of(batches, keys):
        starts = starts_of(*[frame[c].to_numpy() for c in keys])
        for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
            group = frame.iloc[a:b]
            node, copies, side = (group[c].to_numpy() for c in ("node", "copies", "side"))
            unit = np.frombuffer(b"".join(group["unit"]), np.float64).reshape(len(group), -1)
            alone = group["kind"].iloc[0] == 0 and group["i"].iloc[0] == group["j"].iloc[0]
            left = np.arange(len(group)) if alone else np.flatnonzero(side == 0)
            right = left if alone else np.flatnonzero(side == 1)
            links, labels = np.zeros(len(group), np.int64), np.arange(len(group))
            for k in range(0, len(left), 512):
                own = left[k : k + 512]
                hits = unit[own] @ unit[right].T >= threshold
                if alone:
                    hits[np.arange(len(own)), own] = False
                else:
                    links[right] += copies[own] @ hits
                links[own] += hits @ copies[right]
                merge(labels, hits, own, right)
            some = np.flatnonzero(links)
            if len(some):
                yield pd.DataFrame({"node": node[some], "links": links[some], "root": node[labels[some]]})


def link_vectors(df: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: vectors of one label are linked at a cosine of ``threshold`` or more.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or vec_id, link
    with nothing and are components of their own; so do vectors of different lengths. Rows with equal vectors are linked
    and are handled as one node with copies; repeated vec_ids are rows like others. Other columns are not read.
    """
    reach = float(np.sqrt(2 - 2 * threshold))
    vector = df[f"`{embedding}`"].cast("array<double>")
    rows = df.select(df[f"`{vec_id}`"].cast("long").alias("vec_id"), vector.alias("embedding"), df[f"`{label}`"].cast("string").alias("label"))
    # Two hashes stand for a vector where rows are told apart by it. Unequal ones for equal vectors (0.0, -0.0) change nothing.
    rows = rows.withColumns({f"hash_{i}": F.xxhash64("embedding", F.lit(i)) for i in (1, 2)})
    same = ["label", "hash_1", "hash_2"]
    takes_part = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("label", F.when(takes_part, F.col("label")))
    nodes = rows.filter("label IS NOT NULL").groupBy(*same).agg(F.any_value("embedding").alias("embedding"), F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = settle(nodes.withColumn("size", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    found, edges = links_of(nodes, reach, threshold)
    joined = settle(stars(edges), "components").select(F.col("u").alias("node"), F.col("v").alias("root"))
    placed = nodes.select("node", *same, "first", "copies").join(found, "node", "left").join(joined, "node", "left")
    placed = settle(placed.withColumn("root", F.coalesce("root", "node")), "placed")
    firsts = settle(placed.groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    known = settle(placed.join(firsts, "root").select(*same, "copies", "links", "component_id"), "known")
    out = rows.drop("embedding").join(known, same, "left")
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def links_of(nodes: DataFrame, reach: float, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) and spanning links (u, v) of distinct vectors."""
    spark = nodes.sparkSession
    forest = plant(nodes, reach)
    planted = spark.sparkContext.broadcast(forest)  # as large as the sample

    def settle_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, group in batch.groupby(["label", "size"], sort=False):
                unit = unit_rows(group["embedding"])
                home, far = planted.value.home(key, unit)
                yield pd.DataFrame({
                    "node": group["node"].array, "label": key[0], "size": key[1], "copies": group["copies"].array,
                    "unit": [u.tobytes() for u in unit], "home": home, "far": far,
                })

    homes = settle(nodes.select("node", "label", "size", "copies", "embedding").mapInPandas(settle_in, HOMES), "homes")
    # Trees are over a sample: a label that it missed has one node of its own, without bounds.
    apart = F.when(F.col("home") < 0, -1 - F.pmod(F.xxhash64("label", "size"), F.lit(1 << 60))).otherwise(F.col("home"))
    homes = homes.withColumn("home", apart)
    sizes = homes.groupBy("home").agg(F.max("far").alias("radius"), F.count("*").alias("n"), F.sum("copies").alias("copies"))
    sizes = settle(sizes, "radii")
    tree_nodes = sizes.filter("home >= 0").collect()  # as many as the sample has nodes
    forest.radii = {r.home: r.radius for r in tree_nodes}
    hosts = {a: b for key in forest.trees for a, b in forest.hosts(key, reach).items()}

    held = homes.join(sizes.select("home", "radius", F.col("n").alias("members"), F.col("copies").alias("mass")), "home")
    held = held.withColumn("core", (F.col("home") >= 0) & (F.col("far") + F.col("radius") <= reach - SLACK))
    held = settle(held, "held")
    cores = held.groupBy("home").agg(
        F.sum(F.when(F.col("core"), F.col("copies"))).alias("core_mass"),
        F.min(F.when(F.col("core"), F.col("node"))).alias("leader"),
        F.count(F.when(~F.col("core"), 1)).alias("outer"),
    )
    cores = settle(cores, "cores")
    counted = held.join(cores.filter("leader IS NOT NULL"), "home")
    sure = counted.select("node", F.when(F.col("core"), F.col("mass") - F.col("copies")).otherwise(F.col("core_mass")).alias("links"), F.col("leader").alias("root"))

    known = spark.sparkContext.broadcast((forest.centres, forest.radii, hosts))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, radii, hosts = known.value
        for batch in batches:
            for home, group in batch.groupby("home", sort=False):
                targets = hosts.get(home, [])
                if not targets:
                    continue
                unit = np.frombuffer(b"".join(group["unit"]), np.float64).reshape(len(group), -1)
                far = distances(unit, np.stack([centres[t] for t in targets]))
                for k, target in enumerate(targets):
                    near = far[:, k] <= radii[target] + reach + SLACK
                    if near.any():
                        yield group.loc[near, ["node", "copies", "size", "unit"]].assign(host=target)

    visits = settle(held.mapInPandas(visit, "host bigint, node bigint, copies bigint, size int, unit binary"), "visits")
    visitors = settle(visits.groupBy("host").agg(F.count("*").alias("guests")), "visitors")

    def blocks(count: Column) -> Column:
        return F.ceil(count / BLOCK).cast("long")

    def block(count: Column) -> Column:
        return F.pmod(F.xxhash64("node"), F.greatest(blocks(count), F.lit(1)))

    def upto(count: Column) -> Column:
        return F.sequence(F.lit(0).cast("long"), blocks(count) - 1)

    rest = ["node", "copies", "size", "unit"]
    keys = ["host", "kind", "i", "j", "side", *rest]
    outer = held.filter(~F.col("core")).join(cores.select("home", "outer"), "home").withColumn("own", block(F.col("outer")))
    pairs = F.transform(
        upto(F.col("outer")),
        lambda x: F.struct(F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j"), (F.col("own") > x).cast("int").alias("side")),
    )
    within = outer.select(F.col("home").alias("host"), F.lit(0).alias("kind"), F.explode(pairs).alias("p"), *rest)
    within = within.select("host", "kind", "p.i", "p.j", "p.side", *rest)
    met = held.withColumnRenamed("home", "host").join(visitors, "host").withColumn("i", block(F.col("members")))
    met = met.select("host", F.lit(1).alias("kind"), "i", F.explode(upto(F.col("guests"))).alias("j"), F.lit(0).alias("side"), *rest)
    guests = visits.join(visitors, "host").join(sizes.select(F.col("home").alias("host"), F.col("n").alias("members")), "host")
    guests = guests.withColumn("j", block(F.col("guests")))
    guests = guests.select("host", F.lit(1).alias("kind"), F.explode(upto(F.col("members"))).alias("i"), "j", F.lit(1).alias("side"), *rest)
    every = within.select(*keys).unionByName(met.select(*keys)).unionByName(guests.select(*keys))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = every.repartition(parts, "host", "kind", "i", "j").sortWithinPartitions("host", "kind", "i", "j")
    compared = dealt.mapInPandas(lambda batches: compare(batches, threshold), FOUND)
    found = settle(sure.unionByName(compared), "found")
    edges = found.select(F.col("node").alias("u"), F.col("root").alias("v"))
    return found.groupBy("node").agg(F.sum("links").alias("links")), edges
