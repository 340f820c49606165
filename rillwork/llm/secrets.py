"""Secrets in texts, weighed by how many repositories and owners share them.

Fixed patterns find spans; a wider pattern finds further random-looking strings. The hashes of all these values are
aggregated over the whole corpus by distinct repositories and distinct owners. A value that several owners hold is a
widely copied example; one that stays with few of them looks live. Strings of the wider pattern count as spans only
where they look live.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import map_frames, shielded
from rillwork.session import settle

# Fixed patterns of the contract: kinds in their order.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
#: The wider pattern: long strings of mixed characters with at least this entropy, in bits per character.
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
ENTROPY = 3.5

SPAN = "struct<kind:string,start:bigint,stop:bigint,value_start:bigint,value_hash:string>"
FOUND = f"array<{SPAN}>"


def entropy(text: str) -> float:
    return -sum(n / len(text) * log2(n / len(text)) for n in Counter(text).values())


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the fixed patterns, by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end(), m.start(1)) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def random_spans(text: str, base: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Random-looking strings outside the base spans."""
    out = []
    for m in RANDOM.finditer(text):
        word = m[0]
        if any(a < m.end() and m.start() < b for _, a, b, _ in base):
            continue
        if any(c.isdigit() for c in word) and any(c.isalpha() for c in word) and entropy(word) >= ENTROPY:
            out.append(("random", m.start(), m.end(), m.start()))
    return out


def joined(spans: list[tuple[str, int, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with n_assign, n_access, n_hex, base_sha256 and ``found`` (all candidate spans) beside their
    own columns, none of which may have one of these names."""
    extra = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(*x) for x in extra], T.StructField("found", T._parse_datatype_string(FOUND))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                counts, shas, found = [], [], []
                for t in part[text]:
                    t = t or ""
                    base = base_spans(t)
                    counts.append(Counter(s[0] for s in base))
                    shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans = sorted(base + random_spans(t, base), key=lambda s: (s[1], KINDS.index(s[0])))
                    found.append([(k, a, b, v, hashlib.sha256(t[v:b].encode()).hexdigest()) for k, a, b, v in spans])
                yield part.assign(**{f"n_{k}": [c[k] for c in counts] for k in KINDS[:3]}, base_sha256=shas, found=found)

    return map_frames(docs, run, schema)


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, repositories, owners: distinct ones, null counting as one more. Candidates have value_hash,
    repository and owner; they are made distinct first, on the map side too, so a value in a third of all documents costs
    one row per task and repository."""
    each = candidates.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = each.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value_hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def weigh_secrets(
    docs: DataFrame, text: str = "text", repository: str = "source", owner: str = "source", most_owners: int = 2, most_repositories: int = 3, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The columns in ``keep``, n_assign, n_access, n_hex, base_sha256, n_live, n_copied, and ``found``: the base spans
    and the live random ones by start, then kind, each with ``live``.

    A value looks live if at most ``most_owners`` owners and ``most_repositories`` repositories hold it. A null or empty
    text has no spans; null owners are one owner; each row is judged for itself, repeated ones too; columns outside
    ``keep`` are not read; an empty table has no rows.
    """
    named = {"k_text_": text, "k_repository_": repository, "k_owner_": owner}
    own = docs.select(*[docs[f"`{c}`"].alias(f"k_{c}") for c in keep], *[docs[f"`{c}`"].cast("string").alias(n) for n, c in named.items()])
    scanned = find_secrets(own, "k_text_").drop("k_text_").withColumn("row", F.monotonically_increasing_id())
    scanned = settle(scanned, "secrets")  # once written, the row numbers are fixed
    origin = [F.col("k_repository_").alias("repository"), F.col("k_owner_").alias("owner")]
    spans = scanned.filter(F.size("found") > 0).select("row", *origin, F.explode("found").alias("span"))
    values = settle(ownership(spans.select(F.col("span.value_hash").alias("value_hash"), "owner", "repository")), "ownership")
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    judged = spans.select("row", "span", F.col("span.value_hash").alias("value_hash")).join(values, "value_hash")
    fields = ["span.start", "span.kind", "span.stop", "span.value_start", "span.value_hash"]
    judged = judged.select("row", F.struct(*fields, live.alias("live")).alias("span"))
    judged = judged.filter("span.live OR span.kind != 'random'")
    per_row = judged.groupBy("row").agg(F.collect_list("span").alias("spans"))

    def before(x: Column, y: Column) -> Column:
        by_kind = F.array_position(F.lit(list(KINDS)), x["kind"]) - F.array_position(F.lit(list(KINDS)), y["kind"])
        return F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(by_kind).cast("int")

    counted = per_row.select("row", F.array_sort("spans", before).alias("judged"))
    none = F.expr("CAST(array() AS array<struct<start:bigint,kind:string,stop:bigint,value_start:bigint,value_hash:string,live:boolean>>)")
    # Most rows have no candidate: they are not moved.
    some = scanned.filter(F.size("found") > 0).join(counted, "row", "left").withColumn("judged", F.coalesce("judged", none))
    out = some.unionByName(scanned.filter(F.size("found") == 0).withColumn("judged", none))
    return out.select(
        *[F.col(f"k_{c}").alias(c) for c in keep], "n_assign", "n_access", "n_hex", "base_sha256",
        F.size(F.filter("judged", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("judged", lambda s: ~s["live"])).cast("long").alias("n_copied"),
        F.col("judged").alias("found"),
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def mask_live(docs: DataFrame, mask: str = "[SECRET]", **how) -> DataFrame:
    """``docs`` with the values of live-looking spans replaced in ``text`` and n_chars counted anew; other rows and
    columns as they are, whatever their names. Overlapping spans are masked as one."""
    names, kinds, docs = docs.columns, docs.schema, shielded(docs)
    columns, types = docs.columns, docs.schema
    own = dict(zip(names, columns, strict=True))
    body = own[how.get("text", "text")]
    named = {k: own[how.get(k, v)] for k, v in {"text": "text", "repository": "source", "owner": "source"}.items()}
    weighed = weigh_secrets(docs, keep=tuple(columns), **{**how, **named})

    def cut(text: str, spans) -> str:
        out, at = [], 0
        for a, b in sorted((s["value_start"], s["stop"]) for s in spans if s["live"]):
            if b <= at:
                continue
            if a >= at:
                out += [text[at:a], mask]
            at = b
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [cut(t, s) if t else t for t, s in zip(batch[body], batch["found"], strict=True)]
            yield batch[columns].assign(**{body: texts})

    hit = map_frames(weighed.filter("n_live > 0").select(*columns, "found"), run, types)
    if "n_chars" in own:
        hit = hit.withColumn(own["n_chars"], F.length(F.col(body)).cast(kinds["n_chars"].dataType)).select(*columns)
    return weighed.filter("n_live = 0").select(*columns).unionByName(hit).toDF(*names)
