"""Jaccard join of documents on word n-grams by chosen paths.

A document is the set of its shingles (n words each, hashed). A path is a row of tokens that a set has sampled, each with
the same hash function for all sets, so that similar sets sample the same ones: on average 1/threshold tokens a step,
of which a pair at the threshold shares one. Sets with a path in common meet in its bucket. Buckets that are too large
are split by one step more. Repeated runs bring the odds of a pair's never meeting below the target: with 16 runs a pair
at the threshold meets with 1 - exp(-16) after one step and 1 - exp(-10.1) after two. Sets of less than 20 tokens have all
of them as first paths and sample more second ones, so that a pair of them meets with at least 1 - exp(-16) after two.

Identical sets are one node. Pairs in a bucket that differ too much in size or in a short sketch are dropped; the others
join groups, and within each group all sets are compared exactly, block against block, so that also pairs which never met
are found if a common neighbour ties them. Tasks return counts and spanning links, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import groups_of, map_frames, renamed, shielded, starts_of, text_slices
from rillwork.llm.components import stars
from rillwork.llm.covertree import merge
from rillwork.llm.tokens import span_hashes
from rillwork.session import settle

WORDS, THRESHOLD, RUNS = 5, 0.8, 16
#: A bucket of more sets is split by one step more.
LARGE = 256
#: Sets, and shingles, in a block of a comparison.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Bins of a sketch; a pair passes if its estimate is within so many standard errors of the threshold.
BINS, ERRORS = 64, 4.5
#: Shingles in up to so many sets of a comparison are counted pair by pair, others by matrix products.
RARE = 16


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    x = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``words`` words in a row, or all of them if there are fewer."""
    raw = [" ".join(t.split()).encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    empty = np.array([not x for x in raw], bool)  # an empty text is a span of no bytes
    hashes = span_hashes(data, starts, ends).astype(np.uint64)
    counts = np.array([x.count(b" ") + 1 for x in raw], np.int64)
    begins = np.cumsum(counts) - counts
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        rolled[: max(0, len(hashes) - k)] += hashes[k:] * np.uint64(pow(0xD1342543DE82EF95, words - k, 1 << 64))
    rolled = mix(rolled)
    out = []
    for i, (a, n) in enumerate(zip(begins.tolist(), counts.tolist(), strict=True)):
        if empty[i]:
            out.append(np.zeros(0, np.uint64))
        elif n >= words:
            out.append(np.unique(rolled[a : a + n - words + 1]))
        else:
            whole = sum(int(h) * pow(0x2545F4914F6CDD1D, j + 1, 1 << 64) for j, h in enumerate(hashes[a : a + n])) % (1 << 64)
            out.append(mix(np.array([whole], np.uint64), n))
    return out


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def sketch_of(tokens: np.ndarray) -> bytes:
    """Per bin a byte of its smallest token, after a list of the bins that have one."""
    own = np.sort(mix(tokens, 1))
    at = np.searchsorted(own, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
    filled = at < np.append(at[1:], len(own))
    marks = np.zeros(BINS, np.uint8)
    marks[filled] = mix(own[at[filled]], 2) & np.uint64(255)
    return np.packbits(filled).tobytes() + marks.tobytes()


def paths_of(tokens: np.ndarray, threshold: float, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths of one step, and those of two with the step before. Run r samples the tokens whose hash lies in a window
    that begins at r / runs and takes 1 / (threshold * size) of the range."""
    own = mix(tokens, 3)
    order = np.argsort(own)
    place = own[order].astype(np.float64) / 2.0**64
    begin = np.arange(runs) / runs
    share = 1 / (threshold * len(tokens))
    if share >= 1 / runs:
        first = own
    else:
        a, b = np.searchsorted(place, begin), np.searchsorted(place, begin + share)
        first = np.concatenate([own[order[x:y]] for x, y in zip(a, b, strict=True)])
    parents, seconds = [], []
    # Where each token is a first path once, not run by run, the second step is drawn for all runs at once.
    limit = np.uint64(min(max(share, runs * share**2), 1.0) * (2.0**64 - 2048))
    step = max(1, (1 << 20) // len(tokens))
    for k in range(0, len(first), step):
        some = first[k : k + step]
        next_hash = mix(own[None, :] ^ mix(some, 4)[:, None], 5)
        x, y = np.nonzero(next_hash <= limit)
        parents.append(some[x])
        seconds.append(mix(next_hash[x, y] + some[x] * np.uint64(3), 6))
    return first, np.concatenate(parents), np.concatenate(seconds)


SIGNED = "doc_id bigint, digest binary, size bigint, sketch binary, first array<bigint>, parents array<bigint>, seconds array<bigint>"


def signed(docs: DataFrame, words: int, threshold: float, runs: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, b in text_slices(texts):
                rows = []
                for doc_id, tokens in zip(batch["doc_id"].iloc[a:b], shingle_sets(texts[a:b], words), strict=True):
                    if pd.isna(doc_id) or not len(tokens):
                        rows.append((None if pd.isna(doc_id) else int(doc_id), None, 0, None, None, None, None))
                        continue
                    digest = digest_of(tokens)
                    paths = [p.astype(np.int64) for p in paths_of(tokens, threshold, runs)]
                    rows.append((int(doc_id), digest, len(tokens), sketch_of(tokens), *paths))
                frame = pd.DataFrame(rows, columns=["doc_id", "digest", "size", "sketch", "first", "parents", "seconds"], dtype=object)
                yield frame

    return map_frames(docs, run, SIGNED)


def dealt_in_blocks(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Rows once for each pair of blocks (i <= j) that theirs belongs to, ``side`` 1 where it is the second one."""
    own = rows.withColumn("blocks_", F.greatest(blocks.cast("long"), F.lit(1))).withColumn("own_", F.pmod(F.xxhash64("node"), F.col("blocks_")))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks_") - 1),
        lambda x: F.struct(F.least(x, "own_").alias("i"), F.greatest(x, "own_").alias("j"), (F.col("own_") > x).cast("int").alias("side")),
    )
    out = own.withColumn("pair_", F.explode(pairs))
    out = out.select(F.col(key).alias("key"), "pair_.i", "pair_.j", "pair_.side", *[c for c in rows.columns if c != key])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def each_comparison(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(rows, places of the first block, places of the second) of each comparison; the same places for one block."""
    keys = ["key", "i", "j"]
    for frame in groups_of(batches, keys):
        starts = starts_of(*[frame[c].to_numpy() for c in keys])
        for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
            group = frame.iloc[a:b].drop_duplicates(["node", "side"])  # a repeated row may have come twice
            if len(group) > 1:
                side = group["side"].to_numpy()
                alone = group["i"].iloc[0] == group["j"].iloc[0]
                left = np.arange(len(group)) if alone else np.flatnonzero(side == 0)
                yield group, left, left if alone else np.flatnonzero(side == 1)


def candidates(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Spanning links of the pairs in a bucket whose sizes and sketches allow the threshold."""
    for group, left, right in each_comparison(batches):
        node, size = group["node"].to_numpy(), group["size"].to_numpy().astype(float)
        raw = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1)
        filled, marks = np.unpackbits(raw[:, : BINS // 8], axis=1).astype(bool), raw[:, BINS // 8 :]
        labels = np.arange(len(group))
        for k in range(0, len(left), 128):
            own = left[k : k + 128]
            same = np.zeros((len(own), len(right)), np.int16)
            either = np.zeros((len(own), len(right)), np.int16)
            for b in range(BINS):
                x, y = filled[own, b][:, None], filled[right, b][None, :]
                same += x & y & (marks[own, b][:, None] == marks[right, b][None, :])
                either += x | y
            many = np.maximum(either, 1)
            hits = same / many >= threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / many)
            a, b = size[own][:, None], size[right][None, :]
            hits &= np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
            hits &= node[own][:, None] != node[right][None, :]
            merge(labels, hits, own, right)
        some = np.flatnonzero(labels != np.arange(len(group)))
        if len(some):
            yield pd.DataFrame({"u": node[some], "v": node[labels[some]]})


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared tokens of each set of the first list of places with each of the second."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    keep = df[token] > 1
    token, owner = token[keep], owner[keep]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    rare = df[token] <= RARE
    starts = np.flatnonzero(np.diff(token[rare], prepend=-1))
    few = owner[rare]
    for n in range(2, RARE + 1):
        at = starts[np.diff(np.append(starts, len(few))) == n]
        if len(at):
            members = few[at[:, None] + np.arange(n)]
            for x in range(n):
                for y in range(n):
                    if x != y:
                        a, b = row[members[:, x]], column[members[:, y]]
                        fits = (a >= 0) & (b >= 0)
                        np.add.at(out, (a[fits], b[fits]), 1)
    token, owner = token[~rare], owner[~rare]
    if len(token):
        _, token = np.unique(token, return_inverse=True)
        for first in range(0, int(token.max()) + 1, 2048):
            some = (token >= first) & (token < first + 2048)
            a, b = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
            x, y = row[owner[some]], column[owner[some]]
            a[x[x >= 0], token[some][x >= 0] - first] = 1
            b[y[y >= 0], token[some][y >= 0] - first] = 1
            out += a @ b.T
    return out


def verified(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Exact links in each comparison: per node the linked copies, and a node that links join it to."""
    for group, left, right in each_comparison(batches):
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["tokens"]]
        sizes = np.array([len(s) for s in sets], np.float32)
        links, labels = np.zeros(len(group), np.int64), np.arange(len(group))
        shared = overlaps(sets, left, right)
        hits = shared >= threshold * (sizes[left][:, None] + sizes[right] - shared) - 1e-6
        hits &= node[left][:, None] != node[right][None, :]
        links[left] += hits @ copies[right]
        if left is not right:
            links[right] += copies[left] @ hits
        merge(labels, hits, left, right)
        some = np.flatnonzero(links)
        if len(some):
            yield pd.DataFrame({"node": node[some], "links": links[some], "root": node[labels[some]]})


def met(reps: DataFrame) -> DataFrame:
    """(bucket, n, node): who meets where. Buckets of one set are dropped, large ones split, and of buckets with the
    same members one is kept."""

    def summed(entries: DataFrame) -> DataFrame:
        marks = [F.bit_xor(F.xxhash64("node", F.lit(s))).alias(f"x{s}") for s in (1, 2)]
        return entries.groupBy("bucket").agg(F.count("*").alias("n"), *marks).filter("n > 1")

    one = reps.select("node", F.explode(F.array_distinct("first")).alias("bucket"))
    counts = settle(summed(one), "buckets")
    large = counts.filter(F.col("n") > LARGE).select(F.col("bucket").alias("parent"))
    steps = reps.select("node", F.explode(F.arrays_zip("parents", "seconds")).alias("s"))
    steps = steps.select("node", F.col("s.parents").alias("parent"), F.col("s.seconds").alias("bucket"))
    two = settle(steps.join(large, "parent").select("bucket", "node").distinct(), "second-step")
    every = counts.filter(F.col("n") <= LARGE).unionByName(summed(two))
    kept = settle(every.groupBy("n", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "kept")
    return one.unionByName(two.select("node", "bucket")).join(kept, "bucket")


def jaccard_groups(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, runs: int = RUNS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, class_id, n_links, kept, digest of every row. Two rows are linked at a Jaccard similarity of ``threshold``
    or more of their sets of ``words``-word shingles; class_id is the smallest doc_id that links lead to; n_links counts
    the other rows linked directly; the digest is that of the set; of each class the row with the smallest doc_id, then
    digest, is kept.

    Words are what white space separates. A text of fewer words is one shingle. Null texts, texts without a word and rows
    without doc_id have no links, a null digest, and are kept as classes of their own. Rows that repeat a doc_id are rows
    like others; of those that repeat its set too, each is marked kept. Other columns are not read. An empty table has no
    rows.
    """
    own = renamed(docs, doc_id=doc_id, text=text)
    rows = settle(signed(own, words, threshold, runs).withColumn("node", F.monotonically_increasing_id()), "signed")
    known = rows.filter("digest IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min("node").alias("node"))
    classes = settle(classes, "classes")
    reps = settle(known.drop("digest").join(classes.select("node", "first_id", "copies"), "node"), "reps")

    entries = met(reps).join(reps.select("node", "size", "sketch"), "node").select("bucket", "n", "node", "size", "sketch")
    paired = dealt_in_blocks(entries, "bucket", F.ceil(F.col("n") / BLOCK)).mapInPandas(lambda b: candidates(b, threshold), "u bigint, v bigint")
    tied = settle(stars(settle(paired, "candidates")), "tied")
    own_groups = tied.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct()
    groups = tied.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(own_groups)
    members = settle(groups.join(reps.select("node", "doc_id", "copies", "size"), "node").join(classes.select("node", "digest"), "node"), "members")
    sizes = settle(members.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")), "groups")

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in text_slices(batch["text"].tolist()):
                part = batch.iloc[a:b]
                sets = shingle_sets(part["text"].tolist(), words)
                right = [digest_of(s) == d for s, d in zip(sets, part["digest"], strict=True)]
                out = part[["group", "node", "copies"]].assign(tokens=[s.tobytes() for s in sets])
                yield out[right]  # other texts under the same doc_id

    # One plan at every size: with few members Spark would broadcast them, and the texts would be moved in large runs only.
    told = own.filter("text IS NOT NULL").join(members.hint("merge"), "doc_id").select("group", "node", "copies", "text", "digest")
    sets = told.mapInPandas(tokens, "group bigint, node bigint, copies bigint, tokens binary")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES))
    dealt = dealt_in_blocks(settle(sets, "sets").join(sizes, "group"), "group", blocks)
    found = settle(dealt.mapInPandas(lambda b: verified(b, threshold), "node bigint, links bigint, root bigint"), "found")
    roots = settle(stars(found.select(F.col("node").alias("u"), F.col("root").alias("v"))), "roots").select(F.col("u").alias("node"), F.col("v").alias("root"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = settle(placed, "placed")
    firsts = settle(placed.groupBy("root").agg(F.min(F.struct("first_id", "digest")).alias("best")), "firsts")
    leads = F.col("digest") == F.col("best.digest")
    told = settle(placed.join(firsts, "root").select("digest", "copies", "links", F.col("best.first_id").alias("class_id"), leads.alias("leads")), "told")
    out = rows.select("doc_id", "digest").join(told, "digest", "left")
    class_id = F.coalesce("class_id", "doc_id")
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    kept = F.coalesce(F.col("leads") & (F.col("doc_id") == F.col("class_id")), F.lit(True))
    return out.select("doc_id", class_id.alias("class_id"), n_links.alias("n_links"), kept.alias("kept"), "digest")


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, runs: int = RUNS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, others, whatever their names) that ``jaccard_groups`` keeps, one of those that
    repeat doc_id and set."""
    names, docs = docs.columns, shielded(docs)
    columns, own_id, own_text = docs.columns, docs.columns[names.index("doc_id")], docs.columns[names.index("text")]
    groups = settle(jaccard_groups(docs, threshold, words, runs, own_id, own_text).filter("doc_id IS NOT NULL").select(F.col("doc_id").alias(own_id), "kept", "digest"), "judged")
    # Where a number stands for one row, it tells whether the row goes; only rows of repeated numbers are told apart by their sets.
    repeated = settle(groups.groupBy(own_id).agg(F.count("*").alias("n")).filter("n > 1").select(own_id), "repeated")
    gone = groups.filter("NOT kept").select(own_id, F.hex("digest").alias("set_")).distinct()
    alone = docs.join(repeated.unionByName(gone.select(own_id)).distinct(), own_id, "left_anti").select(columns)
    schema = T.StructType([*docs.schema.fields, T.StructField("row_", T.LongType()), T.StructField("set_", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in text_slices([t or "" for t in batch[own_text]]):
                part = batch.iloc[a:b]
                sets = shingle_sets([t or "" for t in part[own_text]], words)
                own = [None if pd.isna(d) or not len(s) else digest_of(s).hex().upper() for d, s in zip(part[own_id], sets, strict=True)]
                yield part.assign(set_=own)

    several = docs.join(repeated, own_id, "left_semi").select(columns)
    marked = map_frames(several.withColumn("row_", F.monotonically_increasing_id()), run, schema)
    marked = marked.withColumn("set_", F.coalesce("set_", F.col("row_").cast("string")))  # rows without a set stay apart
    told_apart = marked.join(gone, [own_id, "set_"], "left_anti").dropDuplicates([own_id, "set_"]).select(columns)
    return alone.unionByName(told_apart).toDF(*names)
