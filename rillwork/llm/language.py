"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to four bytes long is counted on a bounded sample of labelled documents and
then frozen. A byte costs -log2 of its share among the bytes seen after the longest known context; if it was never seen
there, the escape of that context is paid and the next shorter one is asked (escape method C), down to all 256 bytes
alike. The language whose tree codes the text in the fewest bits is predicted.

The trees of all languages lie side by side in one table per order, with the escapes already paid, so that a byte of
text costs one look-up: the longest contexts first, the shorter ones only for bytes that are not in any tree there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import map_frames, renamed, sampled_share, text_slices, without
from rillwork.llm.hashing import KeyTable

ORDER = 4
#: Labelled documents per language that the trees are counted on, about.
DOCS_PER_LANGUAGE = 400
#: More languages than this are refused: the model is a table with a column for each.
MOST_LANGUAGES = 500
#: Bytes worked on at a time.
SLICE = 1 << 19


def gram_keys(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte from the ``ORDER``-th on: the byte and the ``order`` bytes before it, as one number."""
    keys = data[ORDER:].astype(np.int64)
    for back in range(1, order + 1):
        keys |= data[ORDER - back : len(data) - back].astype(np.int64) << (8 * back)
    return keys


def bytes_of(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram (the last ``ORDER`` + 1 bytes, zeros before the text), n; partial counts per slice, then summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in text_slices(texts, SLICE):
                langs = batch["lang"].iloc[a:b].to_numpy()
                for lang in np.unique(langs):
                    keys = [gram_keys(np.frombuffer(bytes(ORDER) + bytes_of(t), np.uint8), ORDER) for t, g in zip(texts[a:b], langs, strict=True) if g == lang]
                    grams, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

    return docs.mapInPandas(run, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Of one order: keys of byte and context with the bits per language; keys of contexts with the escape's bits, 0 for
    languages that do not know the context."""

    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray

    def built(self) -> Level:
        self.find_gram, self.find_context = KeyTable(self.grams), KeyTable(self.contexts)
        return self


class ByteTrees:
    """Frozen trees of all languages."""

    def __init__(self, langs: list[str], levels: list[Level]):
        self.langs, self.levels, self.ready = langs, levels, False

    @staticmethod
    def trained(counts: pd.DataFrame) -> ByteTrees:
        """From lang, gram, n with grams of ``ORDER`` + 1 bytes."""
        langs = sorted(counts["lang"].unique())
        column, gram, n = np.searchsorted(langs, counts["lang"]), counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
        levels: list[Level] = []
        trees = ByteTrees(langs, levels)
        for order in range(ORDER + 1):
            mask = (np.int64(1) << (8 * (order + 1))) - 1
            grams, at = np.unique(gram & mask, return_inverse=True)
            seen = np.zeros((len(grams), len(langs)))
            np.add.at(seen, (at, column), n)
            contexts, of = np.unique(grams >> 8, return_inverse=True)
            total, kinds = (np.zeros((len(contexts), len(langs))) for _ in range(2))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            escapes = np.where(total > 0, np.log2(np.maximum(total + kinds, 1) / np.maximum(kinds, 1)), 0.0)
            below = trees.cost(grams, order - 1, levels)
            own = np.log2((total + kinds)[of] / np.where(seen > 0, seen, 1), where=seen > 0, out=np.zeros_like(seen))
            bits = np.where(seen > 0, own, escapes[of] + below)
            levels.append(Level(grams, bits.astype(np.float32), contexts, escapes.astype(np.float32)).built())
        trees.ready = True
        return trees

    def cost(self, keys: np.ndarray, order: int, levels: list[Level] | None = None) -> np.ndarray:
        """Bits of each byte per language; keys hold the byte and at least ``order`` bytes before it."""
        levels = self.levels if levels is None else levels
        out = np.full((len(keys), len(self.langs)), 8.0, np.float32)
        todo, paid = np.arange(len(keys)), np.zeros((len(keys), len(self.langs)), np.float32)
        for k in range(order, -1, -1):
            own = keys[todo] & ((np.int64(1) << (8 * (k + 1))) - 1)
            place = levels[k].find_gram(own)
            hit = place >= 0
            out[todo[hit]] = paid[todo[hit]] + levels[k].bits[place[hit]]
            todo, own = todo[~hit], own[~hit]
            if not len(todo):
                return out
            context = levels[k].find_context(own >> 8)
            known = context >= 0
            paid[todo[known]] += levels[k].escapes[context[known]]
        out[todo] = paid[todo] + 8.0  # a byte that no language has seen
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text per language."""
        if not self.ready:
            for level in self.levels:
                level.built()
            self.ready = True
        total = np.zeros((len(texts), len(self.langs)))
        pieces, owners, size = [], [], 0

        def flush() -> None:
            nonlocal pieces, owners, size
            if not pieces:
                return
            data = np.frombuffer(b"".join(pieces), np.uint8)
            sizes = np.array([len(p) for p in pieces])
            ends = np.cumsum(sizes)
            inside = np.ones(len(data), bool)  # the bytes before each piece only serve as context
            for back in range(ORDER):
                inside[ends - sizes + back] = False
            places = np.flatnonzero(inside)
            bits = self.cost(gram_keys(data, ORDER)[places - ORDER], ORDER)
            starts = np.concatenate([[0], np.cumsum(sizes - ORDER)[:-1]])
            np.add.at(total, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.float64))
            pieces, owners, size = [], [], 0

        for i, text in enumerate(texts):
            padded = bytes(ORDER) + text
            for at in range(0, len(text), SLICE):
                pieces.append(padded[at : at + SLICE + ORDER])
                owners.append(i)
                size += len(pieces[-1])
                if size >= SLICE:
                    flush()
        flush()
        return total

    def __getstate__(self):
        return {"langs": self.langs, "levels": [Level(x.grams, x.bits, x.contexts, x.escapes) for x in self.levels], "ready": False}


def train(docs: DataFrame, learn: Column, per_language: int = DOCS_PER_LANGUAGE) -> ByteTrees | None:
    """Trees from about ``per_language`` whole documents of each language among the rows where ``learn`` holds.

    ``docs`` has doc_id, text, lang. Rows are taken by a hash of doc_id, the same ones in any run, without a shuffle; the
    gram counts that come to the driver are bounded by the sample. None if there is nothing to learn from.
    """
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = dict(labelled.groupBy("lang").agg(F.count("*")).limit(MOST_LANGUAGES + 1).collect())
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = sampled_share(F.col("doc_id"), 3)
    pick = F.lit(False)
    for lang, n in sorted(sizes.items()):
        pick = pick | ((F.col("lang") == lang) & (share < per_language / n))
    counts = count_grams(labelled.filter(pick)).toPandas()
    return ByteTrees.trained(counts) if len(counts) else None


def predict(docs: DataFrame, trees: ByteTrees | None) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score beside their own columns, from ``text`` alone.

    A null text or one without a letter gets ``und`` and 0, as does every text when there are no trees. The score is the
    probability of the predicted language given the code lengths, all languages alike beforehand; equal code lengths go
    to the first language by name. Rows are judged one by one, whatever their other columns hold; columns that are called
    lang_pred or score already give way.
    """
    docs = without(docs, "lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            for a, b in text_slices(batch["text"].tolist(), SLICE):
                part = batch.iloc[a:b]
                known = [model is not None and has_letter(t) for t in part["text"]]
                langs, scores = np.full(b - a, "und", object), np.zeros(b - a)
                if any(known):
                    bits = model.lengths([bytes_of(t) for t, k in zip(part["text"], known, strict=True) if k])
                    best = bits.argmin(axis=1)
                    rest = np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
                    langs[known], scores[known] = np.array(model.langs, object)[best], 1 / rest
                yield part.assign(lang_pred=langs, score=scores)

    return map_frames(docs, run, schema)


def identify(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; trees from the rows that are not held out (see ``train``,
    ``predict``). ``held_out`` is over the column doc_id; null counts as held out."""
    own = renamed(docs, doc_id=doc_id, text=text, lang=lang)
    apart = F.coalesce(held_out, F.lit(True))
    trees = train(own, ~apart, per_language)
    rows = own.select("doc_id", apart.alias("held_out"), "text")
    return predict(rows, trees).select("doc_id", "held_out", "lang_pred", "score")
