"""Toxicity of texts after noisy-channel deobfuscation.

Words are often disguised: digits and signs for letters, spaces or dots between letters, letters repeated. Each odd token
becomes a lattice of what its characters may stand for, and Viterbi decoding picks the likeliest word under a character
language model (trigrams) and the costs of the disguises. The restored words are then scored with a lexicon that is
learnt from labelled documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import exp, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import map_frames, renamed, sampled_share, text_slices, without
from rillwork.session import settle

#: Fixed table: what a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "ß": "s", "%": "x",
    "а": "a", "е": "e", "о": "o", "с": "c", "р": "p", "х": "x", "і": "i", "у": "y",
}
#: Signs that may stand between letters, and for any one letter.
BETWEEN, ANY = set(".-_*~'`·•,:;/\\ "), set("*#?_")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Costs of the channel, as -log probabilities.
SWAP, DROP, REPEAT, WILD, WILD_DROP = 1.0, 0.5, 0.7, 2.0, 2.0
#: Longer tokens are no single words: repeats are cut short, then they are cut at signs or into overlapping windows.
LONGEST = 60
#: Labelled documents of each class that the lexicon is learnt from, about; the weight of the lexicon in the model.
DOCS_PER_CLASS, OWN_SHARE = 2000, 0.5
#: Words of the lexicon: least weight (a log ratio of rates, less one standard error), least contexts, how many at most.
LEAST_WEIGHT, LEAST_CONTEXTS, MOST_WORDS = 2.0, 8, 1000

#: Tokens whose weights a worker keeps; a full memory is begun anew. It changes no result.
KNOWN = 200_000

LOWER = {c: i + 1 for i, c in enumerate(LETTERS)}  # 0: the edge of a word
N = len(LETTERS) + 1
EDGES = " \t\n\r\v\f.,;:!?\"()[]{}<>«»„“”…'`"
WRAPS = EDGES + "*_-~#&%=^$@|+"
#: Signs that are only punctuation: those that may also stand for a first letter are not among them.
OPENS = "".join(c for c in EDGES if c not in STANDS_FOR)
SIGNS = frozenset(c for c in STANDS_FOR if not c.isalnum())
#: Single characters with signs or spaces between them, in any punctuation; a character is never such a sign, so there is
#: one way to match. ITEMS: its characters, each with the gap behind it.
SPACED = re.compile(r"(?<![^\W_])(?:[^\s.*_-][\s.*_-]++){2,}[^\s.*_-](?![^\W_])")
ITEMS = re.compile(r"([^\s.*_-])([\s.*_-]*+)")
#: Signs that may join words, and disguise them as well: long tokens are cut at each choice of them.
JOINERS = "_$@!|*"
CUTS = [re.compile(r"[^\w$@!|*]+")] + [re.compile(f"(?:[^\\w$@!|*]|[{re.escape(''.join(c))}])+") for n in range(1, 7) for c in combinations(JOINERS, n)]
MANY = re.compile(r"(.)\1{2,}", re.DOTALL)
DOUBLE = re.compile(r"(.)\1+")
#: Lengths of the beginnings of words that are learnt beside whole words: stems with many endings.
STEMS = (4, 5, 6)


def folded(word: str) -> str:
    """In lower case, without accents."""
    word = word.lower()
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def stripped(token: str, signs: str, first: str | None = None) -> str:
    """Without the characters at both ends that are in ``signs``, or neither letters, digits nor known disguises;
    ``first``: the signs of the beginning, if others."""

    def goes(ch: str, signs: str) -> bool:
        return ch in signs or not (ch.isalnum() or ch in STANDS_FOR or ch in ANY)

    a, b = 0, len(token)
    while a < b and goes(token[a], signs if first is None else first):
        a += 1
    while a < b and goes(token[b - 1], signs):
        b -= 1
    return token[a:b]


def once(word: str) -> str:
    """Without repeated characters."""
    return DOUBLE.sub(r"\1", word)


def features(word: str) -> list[str]:
    """What a word may be known by: itself, and its beginnings marked with ``~``."""
    return [word, *[word[:n] + "~" for n in STEMS if len(word) > n]]


@dataclass
class Model:
    """``costs[a, b, c]``: -log P(c | a b) of the letters, 0 for the edge. ``lexicon``: how much more often toxic
    documents have the word, or a word that begins so (``~``), as a log ratio. ``beta``: weights of ``evidence``."""

    costs: np.ndarray
    lexicon: dict[str, float]
    beta: list[float]
    known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.steps = self.costs.tolist()
        self.targets: dict[str, list[str]] = {}
        self.short = {once(w): p for w, p in sorted(self.lexicon.items())}
        self.sizes = sorted({len(w) for w in [*self.lexicon, *self.short] if not w.endswith("~")})
        for word in sorted({w.rstrip("~") for w in self.short}):
            self.targets.setdefault(word[0], []).append(word)

    def restore(self, token: str) -> str:
        """The likeliest word behind the token: Viterbi over (last two letters) along the lattice of its characters."""
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        previous, costs = "", self.steps
        for ch in token:
            options = [(LOWER[ch], 0.0)] if ch in LOWER else []
            options += [(LOWER[x], SWAP) for x in STANDS_FOR.get(ch, "")]
            if ch in ANY:
                options += [(i, WILD) for i in range(1, N)]
            drop = WILD_DROP if ch in ANY else DROP
            free = ch in BETWEEN or not options
            letters = {c for c, _ in options}
            step: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, word) in best.items():
                ways = [((b, c), cost + extra + costs[a][b][c], word + LETTERS[c - 1]) for c, extra in options]
                if free:
                    ways.append(((a, b), cost + drop, word))
                elif ch == previous and b in letters:
                    ways.append(((a, b), cost + REPEAT, word))  # one more of the same
                for state, total, made in ways:
                    if state not in step or total < step[state][0]:
                        step[state] = total, made
            best, previous = step, ch
        ends = [(cost + costs[a][b][0], word) for (a, b), (cost, word) in best.items()]
        return min(ends)[1] if ends else ""

    def look_up(self, word: str) -> float:
        return max(self.lexicon.get(f, 0.0) for f in features(word)) if word else 0.0

    def look_up_restored(self, word: str) -> float:
        """Restored words may have lost one of two equal letters."""
        return max(self.look_up(word), *[self.short.get(f, 0.0) for f in features(once(word))])

    def look_inside(self, text: str) -> float:
        """The weightiest word anywhere in a text without gaps."""
        get, short = self.lexicon.get, self.short.get
        found = 0.0
        for x in {text, once(text)}:
            for i in range(len(x)):
                parts = [x[i : i + n] for n in self.sizes if i + n <= len(x)] + [x[i : i + n] + "~" for n in STEMS if i + n < len(x)]
                found = max(found, *[max(get(p, 0.0), short(p, 0.0)) for p in parts], 0.0)
        return found

    def may_be(self, token: str) -> bool:
        """Whether any path of the lattice can lead to a word of the lexicon: letters only stand for themselves, so up
        to the word's end they come in its order, and signs must make up for what is missing."""
        first = token[0]
        starts = first if first in LOWER else STANDS_FOR.get(first, LETTERS)  # what is neither may be dropped
        for letter in starts:
            for word in self.targets.get(letter, ()):
                at = signs = 0
                last = letter = ""
                for ch in token:
                    if ch not in LOWER or (ch == letter and ch != last):  # signs between equal letters may be dropped
                        signs += 1
                    elif ch != last:
                        letter = ch
                        found = word.find(ch, at)
                        if found < 0 or found - at > signs:
                            break
                        signs -= found - at
                        at = found + 1
                    last = ch
                    if at + signs >= len(word):
                        return True
        return False

    def weight(self, token: str) -> float:
        """Weight of the word that the token stands for, 0 where it is not in the lexicon."""
        if len(token) > LONGEST:
            token = MANY.sub(r"\1\1", token)
        word = folded(stripped(token, WRAPS))
        if plain := word.isascii() and word.isalpha():
            found = self.look_up(word)
            if found or len(word) <= LONGEST and not (DOUBLE.search(word) or any(c in SIGNS for c in token)):
                return found
        if len(word) > LONGEST:
            return self.weight_of_long(token)
        tries = {word, *[folded(x) for x in (stripped(token, EDGES), stripped(token, EDGES, OPENS), token.strip())]}
        tries = [x for x in tries if len(x) > 1 and any(c in LOWER for c in x) and len(x) <= 2 * LONGEST and self.may_be(x)]
        return max((self.look_up_restored(self.restore(x)) for x in sorted(tries)), default=0.0)

    def weight_of_long(self, token: str) -> float:
        """The largest weight of what a long token is joined of: its parts between signs, for each choice of the signs that
        join words rather than disguise them, and windows of parts that no sign cuts, each sharing half with the next."""
        parts = {x for cut in CUTS for x in cut.split(token) if len(x) > 1}
        found = max((self.weight(x) for x in sorted(parts) if len(x) <= LONGEST), default=0.0)
        for part in {folded(x) for x in CUTS[-1].split(token) if len(x) > LONGEST}:
            windows = [part[k : k + 2 * LONGEST] for k in range(0, max(1, len(part) - LONGEST), LONGEST)]
            found = max(found, *[self.look_inside(x) for w in windows for x in {w, self.restore(w)}])
        return found

    def spaced_weights(self, run: str) -> list[float]:
        """Of the words in a run of spaced-out characters: of all of them, or of what wider gaps and signs leave together."""
        items = ITEMS.findall(run)
        least = min(len(gap) for _, gap in items[:-1])
        words, word = [], ""
        for ch, gap in items:
            letter = ch.isalnum() or ch in STANDS_FOR or ch in ANY
            word += ch if letter else ""
            if (not letter or len(gap) > least) and word:
                words.append(word)
                word = ""
        words += [word] if word else []

        def found(word: str) -> list[float]:
            tries = []
            for letters in {folded(word), folded(stripped(word, EDGES))}:
                tries += [letters, "".join(self.restore(letters[i : i + LONGEST]) for i in range(0, len(letters), LONGEST))]
            return [max(self.look_up(x[i : i + LONGEST]) for x in tries) for i in range(max(map(len, tries)))]

        whole, apart = found("".join(ch for ch, _ in items)), [w for x in words for w in found(x)]
        return max(whole, apart, key=sum)

    def weights(self, text: str) -> list[float]:
        """Of all tokens of the text that stand for words of the lexicon."""
        if len(self.known) > KNOWN:
            self.known = {}
        known = self.known
        tokens = text.split()
        for token in set(tokens).difference(known):
            known[token] = self.weight(token)
        out = [w for t in tokens if (w := known[t])]
        for match in SPACED.finditer(text):
            out += self.spaced_weights(match[0])
        return sorted(w for w in out if w)

    def evidence(self, text: str | None) -> list[float]:
        """The sum of the weights, their share of the text's words, the largest one, and the length; 0 without words."""
        weights, n = self.weights(text or ""), len((text or "").split())
        total = sum(weights)
        return [1.0, log1p(total), log1p(100 * total / n) if n else 0.0, weights[-1] if weights else 0.0, log1p(n)]

    def score(self, text: str | None) -> float:
        z = sum(b * x for b, x in zip(self.beta, self.evidence(text), strict=True))
        return 1 / (1 + exp(-min(max(z, -30.0), 30.0)))

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


CODES = np.zeros(0x110000, np.uint8)
CODES[[ord(c) for c in LETTERS]] = range(1, N)
CODES[[ord(c) for c in LETTERS.upper()]] = range(1, N)


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of letter trigrams inside words, two edges before and one after each word."""
    text = "  ".join(["", *texts, ""])
    codes = CODES[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")].astype(np.int64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    keep = ~((b == 0) & (c == 0))
    a = np.where(b == 0, 0, a)
    return np.bincount((a * N + b)[keep] * N + c[keep], minlength=N**3)


TRIGRAMS = T.StructType([T.StructField("trigram", T.LongType()), T.StructField("n", T.LongType())])
WORDS = T.StructType([T.StructField("word", T.StringType()), T.StructField("before", T.StringType()), T.StructField("toxic", T.IntegerType())])


def language_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts of all documents: tasks sum their own, then the few thousand kinds are summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(N**3, np.int64)
        for batch in batches:
            texts = [t for t in batch["text"] if t]
            for a, b in text_slices(texts):
                total += trigram_counts(texts[a:b])
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"trigram": seen, "n": total[seen]})

    rows = docs.select("text").mapInPandas(run, TRIGRAMS).groupBy("trigram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(N**3)
    for row in rows:
        out[row.trigram] = row.n
    return out


def letter_costs(corpus: np.ndarray, words: list[str]) -> np.ndarray:
    """-log P(c | a b): the corpus and the words to be found, half and half, both leaning on shorter contexts."""

    def model(counts: np.ndarray) -> np.ndarray:
        counts = counts.reshape(N, N, N)
        single = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + N)
        pair = (counts.sum(axis=0) + 5 * single) / (counts.sum(axis=(0, 2))[:, None] + 5)
        return (counts + 5 * pair) / (counts.sum(axis=2, keepdims=True) + 5)

    mixed = (1 - OWN_SHARE) * model(corpus) + OWN_SHARE * model(trigram_counts(words).astype(float) if words else corpus)
    return -np.log(mixed).astype(np.float32)


def learn_lexicon(docs: DataFrame) -> dict[str, float]:
    """Words that toxic documents have far more often, with their weights. ``docs``: a bounded sample, text and toxic.

    A word counts once for each different word before it, so copies of one text add nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = [folded(stripped(w, WRAPS)) for w in text.split()]
                pairs = {(w, v) for v, w in zip(["", *words], words, strict=False) if len(w) > 2 and w.isascii() and w.isalpha()}
                pairs = sorted({(f, v) for w, v in pairs for f in features(w)})
                yield pd.DataFrame(pairs, columns=["word", "before"]).assign(toxic=int(toxic))

    pairs = docs.filter(F.col("text").isNotNull()).select("text", "toxic").mapInPandas(run, WORDS)
    pairs = pairs.groupBy("word", "before").agg(F.max("toxic").alias("bad"), F.max(1 - F.col("toxic")).alias("good"))
    words = settle(pairs.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "words")
    totals = words.filter(~F.endswith("word", F.lit("~"))).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    ratio = log(((totals.good or 0) + 1) / ((totals.bad or 0) + 1))
    bad, good = F.col("bad") + 0.5, F.col("good") + 0.5
    weight = F.log(bad / good) + ratio - F.sqrt(1 / bad + 1 / good)
    strong = words.filter(F.col("bad") >= LEAST_CONTEXTS).select("word", "bad", weight.alias("weight")).filter(F.col("weight") >= LEAST_WEIGHT)
    rows = strong.orderBy(F.desc(F.col("bad") * F.col("weight")), "word").limit(MOST_WORDS).collect()
    return {r.word: float(r.weight) for r in rows}


def fitted(rows: list[tuple[list[float], int]], sizes: dict[int, int]) -> list[float]:
    """Logistic weights by Newton steps on the sample, each class weighed as it occurs; slightly held towards 0."""
    x, y = np.array([r for r, _ in rows]), np.array([t for _, t in rows], float)
    seen = np.array([max(1, (y == 0).sum()), max(1, y.sum())])
    each = np.array([sizes.get(0, 0), sizes.get(1, 0)])[y.astype(int)] / seen[y.astype(int)]
    beta, hold = np.zeros(x.shape[1]), np.diag([1e-3, *[0.1] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (each * p * (1 - p))[:, None]) + hold, x.T @ (each * (y - p)) - hold @ beta)
        beta = beta + step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return beta.tolist()


EVIDENCE = T.StructType([T.StructField("evidence", T.ArrayType(T.DoubleType())), T.StructField("toxic", T.IntegerType())])


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """The model from about ``DOCS_PER_CLASS`` labelled documents of each class where ``learn`` (over doc_id) holds, taken by
    a hash of doc_id, and from the letters of all documents.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic. Null labels say nothing. Without labels the lexicon is empty.
    """
    known = labels.filter(learn & F.col("toxic").isNotNull()).select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    sizes = dict(known.groupBy("toxic").agg(F.count("*")).collect())
    share, pick = sampled_share(F.col("doc_id"), 5), F.lit(False)
    for toxic, n in sizes.items():
        pick = pick | ((F.col("toxic") == toxic) & (share < DOCS_PER_CLASS / n))
    # The sample has about twice DOCS_PER_CLASS rows of two numbers, whatever the corpus: small enough for every task.
    sample = docs.join(F.broadcast(known.filter(pick)), "doc_id")
    lexicon = learn_lexicon(sample) if len(sizes) == 2 else {}
    model = Model(letter_costs(language_counts(docs), sorted(w.rstrip("~") for w in lexicon)), lexicon, [0.0] * 5)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"evidence": [shared.value.evidence(t) for t in batch["text"]], "toxic": batch["toxic"]})

    rows = [(r.evidence, r.toxic) for r in sample.select("text", "toxic").mapInPandas(weigh, EVIDENCE).collect()] if lexicon else []
    base = log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 1.0))
    return Model(model.costs, lexicon, fitted(rows, sizes) if rows else [min(base, -0.01), 0.0, 0.0, 0.0, 0.0])


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with score and predicted beside their own columns, from ``text`` alone.

    The score is a logistic one of what the restored words weigh together, by their share, and at most; a null or empty
    text has no words. Rows are judged one by one; columns that are called score or predicted already give way.
    """
    docs = without(docs, "score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                scores = np.array([own.score(t) for t in part["text"]])
                yield part.assign(score=scores, predicted=(scores >= 0.5).astype(np.int32))

    return map_frames(docs, run, schema)


def judge(docs: DataFrame, labels: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of held-out rows are not used. ``held_out`` is over
    doc_id; null counts as held out. Other columns are not read; repeated rows are scored each."""
    own = renamed(docs, doc_id=doc_id, text=text)
    apart = F.coalesce(held_out, F.lit(True))
    model = train(own, renamed(labels, doc_id="doc_id", toxic="toxic"), ~apart)
    return score_texts(own.select("doc_id", apart.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
