"""A hash tree over a table, kept as few levels, and proofs that rows belong to it.

Leaves are hashes of rows. Within a group they ascend by their key; every 16 consecutive nodes become the hash of their
digests, until one is left, the group's subroot. Subroots, ordered by group, become the root in the same way.

Only every second level is written, as rows of aligned subtrees: 256 consecutive nodes each, so that building a level and
taking proofs from it read whole subtrees and never more than that at once. The levels between are not kept: proof
extraction goes from the top down, regenerates the missing nodes of each subtree from its stored descendants, hands
the siblings on the way to the nodes below, and forgets them.

A subtree is of bounded size whatever its group, so a group that holds a third of all rows is just many subtrees, and the
number of passes is the logarithm of the largest group's size. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.common import crc_of
from rillwork.operators.batches import number_rows
from rillwork.session import fresh_dir, settle

# Fixed values of the contract.
FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level in this many is written; a stored subtree has ``FAN_OUT ** KEEP_EVERY`` nodes at most.
KEEP_EVERY = 2

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_PATH = "CAST(array() AS array<struct<left:string,right:string>>)"


@dataclass(frozen=True)
class Tree:
    """Written levels, each (tree, part, width, nodes): the subtrees of the level's nodes, with the number of nodes of
    that level. ``nodes`` holds the place and hash of each and, in the lowest level, what its leaf carries."""

    levels: tuple[str, ...]
    roots: DataFrame

    def level(self, spark: SparkSession, i: int) -> DataFrame:
        return spark.read.parquet(self.levels[i])


def row_hash(*values: Column) -> Column:
    """Hash of a row: each value as its length in bytes, ``:`` and its text, a null as ``-``."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def hash_of(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def above(digests: Column) -> Column:
    """The next level's nodes of consecutive nodes that begin at a multiple of the fan-out."""
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FAN_OUT).cast("int"))
    return F.transform(runs, lambda i: hash_of(F.slice(digests, i * FAN_OUT + 1, F.lit(FAN_OUT))))


def wider(width: Column) -> Column:
    """Nodes of the next level: a single node is a root and stays as it is."""
    return F.ceil(width / FAN_OUT).cast("long")


def regenerate(df: DataFrame, digests: Column, keep_every: int) -> DataFrame:
    """Columns level_0, level_1, ... and width_0, width_1, ...: the nodes of a subtree from stored ones upwards. Where a
    tree is down to one node its levels are equal from there on."""
    df = df.withColumn("level_0", digests).withColumn("width_0", F.col("width"))
    for i in range(keep_every):
        level, width = F.col(f"level_{i}"), F.col(f"width_{i}")
        df = df.withColumn(f"level_{i + 1}", F.when(width > 1, above(level)).otherwise(level)).withColumn(f"width_{i + 1}", wider(width))
    return df


def grouped(nodes: DataFrame, columns: Sequence[str], span: int) -> DataFrame:
    """(tree, part, nodes): aligned subtrees of (tree, pos, ...); at most ``span`` nodes each, in order."""
    part = F.floor(F.col("pos") / span).cast("long").alias("part")
    return nodes.groupBy("tree", part).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("nodes"))


def build_tree(leaves: DataFrame, carried: Sequence[str], keep_every: int = KEEP_EVERY) -> Tree:
    """Write the tree over numbered leaves (tree, pos from 0, hash, and columns to carry)."""
    spark, span = leaves.sparkSession, FAN_OUT**keep_every
    sizes = settle(leaves.groupBy("tree").agg(F.count("*").alias("width")), "widths").withColumnRenamed("tree", "of")
    largest = sizes.agg(F.max("width")).first()[0] or 0
    nodes, columns, levels = leaves, ["pos", "hash", *carried], []
    while True:
        subtrees = grouped(nodes, columns, span).join(sizes, F.col("tree").eqNullSafe(F.col("of"))).drop("of")
        levels.append(fresh_dir(spark, f"level-{keep_every * len(levels)}"))
        subtrees.write.parquet(levels[-1])
        climbed = regenerate(spark.read.parquet(levels[-1]), F.col("nodes.hash"), keep_every)
        nodes = climbed.select("tree", F.col("part").alias("pos"), F.col(f"level_{keep_every}")[0].alias("hash"))
        columns = ["pos", "hash"]
        for _ in range(keep_every):
            sizes, largest = sizes.withColumn("width", wider(F.col("width"))), -(-largest // FAN_OUT)
        if largest <= 1:
            return Tree(tuple(levels), settle(nodes.select("tree", "hash"), "roots"))


def siblings(level: Column, width: Column, at: Column) -> Column:
    """Digests left and right of a node in its run, as a list of one step; an empty list for a root."""
    first = F.floor(at / FAN_OUT).cast("int") * FAN_OUT
    left = F.array_join(F.slice(level, first + 1, at - first), "")
    right = F.array_join(F.slice(level, at + 2, FAN_OUT - 1 - (at - first)), "")
    return F.when(width > 1, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.expr(NO_PATH))


def extract_paths(tree: Tree, tops: DataFrame, passed: Sequence[str], carried: Sequence[str], keep_every: int = KEEP_EVERY) -> DataFrame:
    """tree, pos, hash, the carried and passed columns, and ``path`` of every leaf: the digests left and right of it at
    each level, from its own one up. ``tops`` has (tree, path, passed columns): where the paths of a tree go on above its root."""
    spark = tops.sparkSession
    paths = tops.select("tree", F.lit(0).cast("long").alias("pos"), "path", *passed)
    for i in reversed(range(len(tree.levels))):
        fields = ["pos", *(["hash", *carried] if i == 0 else [])]
        upper = paths.select(F.col("tree").alias("of"), F.col("pos").alias("under"), "path", *passed)
        subtrees = tree.level(spark, i).join(upper, F.col("tree").eqNullSafe(F.col("of")) & (F.col("part") == F.col("under")))
        full = regenerate(subtrees, F.col("nodes.hash"), keep_every)

        def step(node: Column, at: Column) -> Column:
            steps = [siblings(F.col(f"level_{j}"), F.col(f"width_{j}"), F.floor(at / FAN_OUT**j).cast("int")) for j in range(keep_every)]
            return F.struct(*[node[c].alias(c) for c in fields], F.concat(*steps, F.col("path")).alias("path"))

        paths = full.select("tree", *passed, F.inline(F.transform("nodes", step)))
        paths = settle(paths, "paths") if i else paths
    return paths


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


@dataclass(frozen=True)
class Manifest:
    """The trees of all groups, the tree over their subroots, and the root (null for an empty table)."""

    groups: Tree
    top: Tree
    root: str | None


def build_manifest(leaves: DataFrame, key: str, carried: Sequence[str] = (), keep_every: int = KEEP_EVERY) -> Manifest:
    """The manifest of written leaves (tree: the group, ``key``, hash, and columns to carry). Leaves of a group ascend by
    key, null first, then by hash; groups are ordered bytewise, null first."""
    numbered = number_rows(leaves.select("tree", key, "hash", *carried), ["tree"], [key, "hash"], "pos")
    groups = build_tree(numbered.withColumn("pos", F.col("pos") - 1), [key, *carried], keep_every)
    subroots = groups.roots.select(F.lit("all").alias("tree"), F.col("tree").alias("group"), "hash")
    ordered = number_rows(subroots, [], ["group"], "pos").withColumn("pos", F.col("pos") - 1)
    top = build_tree(ordered, ["group"], keep_every)
    root = top.roots.first()
    return Manifest(groups, top, root.hash if root else None)


def extract_proofs(spark: SparkSession, manifest: Manifest, key: str, carried: Sequence[str] = (), keep_every: int = KEEP_EVERY) -> DataFrame:
    """tree, pos, key, hash, carried columns, subroot and ``path`` to the root of every leaf."""
    start = manifest.top.roots.select("tree", F.expr(NO_PATH).alias("path"))
    tops = extract_paths(manifest.top, start, [], ["group"], keep_every)
    tops = settle(tops.select(F.col("group").alias("tree"), "path", F.col("hash").alias("subroot")), "tops")
    return extract_paths(manifest.groups, tops, ["subroot"], [key, *carried], keep_every)


def audit(docs: DataFrame, keep_every: int = KEEP_EVERY) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    Documents whose number's crc32 is divisible by 5 are tampered with, after the manifest is made, by small letters for
    capitals; ``folded_root`` is what the document as it then stands and the stored siblings give. A null number is never
    tampered with and sorts first; a null source is a group of its own, before all others; null values and empty texts
    have hashes unlike each other. Repeated rows are leaves of their own, and rows with one number ascend by hash.
    Texts of any length are hashed whole; other columns are not read; an empty table has no rows.
    """
    spark = docs.sparkSession
    own = docs.select(*[docs[f"`{c}`"].alias(c) for c in FIELDS])
    tampered = F.coalesce(F.pmod(crc_of("doc_id"), F.lit(5)) == 0, F.lit(False)) & F.col("text").rlike("[A-Z]")
    values = [F.col(c) for c in FIELDS]
    changed = row_hash(*values[:-1], F.translate("text", CAPITALS, SMALL))
    leaves = own.select("doc_id", F.col("source").alias("tree"), row_hash(*values).alias("hash"), F.when(tampered, changed).alias("changed"))
    leaves = settle(leaves, "leaves")
    manifest = build_manifest(leaves, "doc_id", ["changed"], keep_every)
    proofs = extract_proofs(spark, manifest, "doc_id", ["changed"], keep_every)
    root = F.lit(manifest.root).cast("string")
    folded = fold(F.coalesce("changed", "hash"), F.col("path"))
    out = proofs.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
