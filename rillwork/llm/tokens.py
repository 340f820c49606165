"""Token ids of whole texts by way of the distinct words that texts are made of.

A tokenizer that splits a text before it merges gives the same ids for the text as for its parts one by one, if every
cut lies where the tokenizer cuts anyway. In a text whose white space is single spaces and line breaks such places are
before a space, before and after a line break, and between a letter and a sign other than an apostrophe; any other text
is one part, and so is a text that holds a string of the vocabulary's added tokens, where those count. Parts are told apart by a 64-bit hash that is computed for all of them at once, so that only new ones, which
become rare, are ever cut out of the text and given to the tokenizer. Each worker process keeps what it has met.

Two different parts of one memory share a hash with odds of about 3 in 100 million.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import numpy as np

from rillwork.llm.common import pick_runs
from rillwork.llm.hashing import GrowingTable

#: Parts whose ids a worker keeps, and 8 times as many ids; a full memory is begun anew. It changes no result.
KEPT = 700_000
#: Longer parts, in bytes, are not kept.
LONGEST = 64

#: White space, letters, signs: what most new parts look like.
SIMPLE = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&]*)")

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

BASE = 0x5851F42D4C957F2D
LETTER, SIGN = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True

# White space other than space and line break, of one byte and of several, as numbers of their bytes.
ODD_SPACE, LEADS = np.zeros(256, bool), np.zeros(256, bool)
ODD_SPACE[[9, 11, 12, 13, 28, 29, 30, 31]] = True
WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE_SPACES = np.array([int.from_bytes(c.encode(), "big") for c in WIDE_SPACE])
LEADS[[c.encode()[0] for c in WIDE_SPACE]] = True


class Powers:
    """Powers of the hash's base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = [np.full(size, b, np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
            for x in steps:
                x[0] = 1
            self.up, self.down = (np.cumprod(x, dtype=np.uint64) for x in steps)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, not negative: differences of one running sum."""
    up, down = POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    values = (sums[ends] - sums[starts]) * down[starts]
    values ^= values >> np.uint64(31)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    return ((values ^ (values >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def part_starts(data: np.ndarray, sizes: np.ndarray, regular: np.ndarray) -> np.ndarray:
    """Where the parts of texts of these sizes begin; texts that are not regular are one part."""
    cut = np.zeros(len(data) + 1, bool)
    cut[:-1] = (data == 32) | (data == 10)
    cut[1:][data == 10] = True
    cut[1:-1] |= SIGN[data[1:]] & LETTER[data[:-1]]
    if not regular.all():
        cut[:-1] &= np.repeat(regular, sizes)
    cut[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return np.flatnonzero(cut[:-1])


def regular_texts(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which texts of these sizes, one after the other, have no white space but single spaces and line breaks."""
    regular = np.ones(len(sizes), bool)
    ends = np.cumsum(sizes)
    space = (data == 32) | (data == 10)
    touching = space[:-1] & space[1:]
    touching[ends[(ends > 0) & (ends < len(data))] - 1] = False  # of two texts
    wide = np.flatnonzero(data >= 0xC2)
    wide = wide[LEADS[data[wide]]]
    codes = np.zeros(len(wide), np.int64)
    for k in range(3):
        codes = codes << 8 | np.where(wide + k < len(data), data[np.minimum(wide + k, len(data) - 1)], 0)
    odd = np.isin(codes, WIDE_SPACES) | np.isin(codes >> 8, WIDE_SPACES)
    for bad in (np.flatnonzero(touching), np.flatnonzero(ODD_SPACE[data]), wide[odd]):
        regular[np.searchsorted(ends, bad, side="right")] = False
    return regular


class WordMemory:
    """Ids of texts from ids of their parts; ``encode`` maps new parts to (all ids, count per part). Texts for which
    ``uncut`` holds are one part."""

    def __init__(self, encode: Encoder, kept: int = KEPT, uncut: Callable[[str], bool] | None = None):
        self.encode, self.kept, self.uncut = encode, kept, uncut or (lambda text: False)
        self.clear()

    def clear(self) -> None:
        self.table, self.known = GrowingTable(), 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self, parts: list[str]) -> np.ndarray:
        """Places of new parts."""
        ids, counts = self.encode(parts)
        at, need = self.known, self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(need, np.uint32)])
        if at + len(parts) > len(self.starts):
            self.starts, self.counts = (np.concatenate([x[:at], np.zeros(at + 2 * len(parts), np.int64)]) for x in (self.starts, self.counts))
        self.flat[self.used : need] = ids
        self.known, self.used = at + len(parts), need
        self.starts[at : self.known] = need - len(ids) + np.cumsum(counts) - counts
        self.counts[at : self.known] = counts
        return np.arange(at, self.known)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the count of each."""
        if self.known > self.kept or self.used > 8 * self.kept:
            self.clear()
        raw = [t.encode("utf-8", "replace") for t in texts]
        sizes = np.array([len(x) for x in raw], np.int64)
        whole = b"".join(raw)
        data = np.frombuffer(whole, np.uint8)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        begins = part_starts(data, sizes, regular_texts(data, sizes) & ~np.array([self.uncut(t) for t in texts], bool))
        ends = np.append(begins[1:], len(data))
        keys = span_hashes(data, begins, ends)
        place = self.table(keys)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            own = missing[first]
            places = self.learn([whole[a:b].decode() for a, b in zip(begins[own].tolist(), ends[own].tolist(), strict=True)])
            place[missing] = places[back]
            keep = ends[own] - begins[own] <= LONGEST
            self.table.add(new[keep], places[keep])
        lengths = self.counts[place]
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(begins, np.cumsum(sizes))]
        return pick_runs(self.flat, self.starts[place], lengths), np.diff(upto, prepend=0)


_MEMORIES: dict[tuple, WordMemory] = {}


def shared_memory(key: tuple, build: Callable[[], Encoder]) -> WordMemory:
    """The memory of this worker process for a vocabulary: tasks that run in the process one after the other share it."""
    if key not in _MEMORIES:
        _MEMORIES[key] = WordMemory(build())
    return _MEMORIES[key]


def library_memory(path: str, special: bool = False) -> WordMemory:
    memory = shared_memory(("library", path, special), lambda: library_encoder(path, special))
    if special:
        memory.uncut = holder_of_added(path)
    return memory


@cache
def holder_of_added(path: str) -> Callable[[str], bool]:
    """Whether a text may hold a string of the added tokens of the vocabulary at ``path``."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = list(tokenizer.get_added_tokens_decoder().values())
    plain, normal = [t.content for t in added], [t.content for t in added if t.normalized]
    if not normal or tokenizer.normalizer is None:
        return lambda text: any(s in text for s in plain)
    normalize = tokenizer.normalizer.normalize_str
    normal += [normalize(s) for s in normal]
    return lambda text: any(s in text for s in plain) or any(s in normalize(text) for s in normal)


def byte_letters() -> dict[int, str]:
    """The fixed letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others
    for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def library_encoder(path: str, special: bool = False) -> Encoder:
    """The tokenizers library with the vocabulary at ``path``. Strings of special tokens are ordinary text, or these
    tokens if ``special``, as by the library's default.

    Parts of letters and closing signs skip the library's general normalizing and splitting, whose outcome for them is
    plain; their pieces go to the library's model, thousands in a call. A probe at the start makes sure of that outcome.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    held = holder_of_added(path) if special else lambda part: False
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    letters, lowers = byte_letters(), tokenizer.normalizer is not None

    def pieces_of(space: str, word: str, signs: str) -> list[str]:
        if lowers:
            word, space = word.lower(), ""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(letters)
        head = [letters[10], word] if space == "\n" else [letters[32] + word] if space else [word]
        return [*head, signs] if signs else head

    def general(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.uint32, int(counts.sum())), counts

    def simple(matches: list) -> tuple[np.ndarray, np.ndarray]:
        pieces = [pieces_of(*m.groups()) for m in matches]
        owner = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        got = bare.encode(" ".join([p for x in pieces for p in x]), add_special_tokens=False)
        return np.array(got.ids, np.uint32), np.bincount(owner[np.array(got.word_ids, np.int64)], minlength=len(pieces))

    probe = [" Straße,", " the", "\nThe", "thé;!", " don", "Ünder.", " ÀÉ...", "\nà?!", " be***", "z$$$", " Á%&#"]
    want = [x.tolist() for x in general(probe)]
    usable = [x.tolist() for x in simple([SIMPLE.fullmatch(p) for p in probe])] == want

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        matches = [None if held(p) else SIMPLE.fullmatch(p) for p in parts] if usable else [None] * len(parts)
        easy = np.fromiter((m is not None for m in matches), bool, len(parts))
        counts, made, order = np.zeros(len(parts), np.int64), [np.zeros(0, np.uint32)], []
        for where, source, how in ((np.flatnonzero(easy), matches, simple), (np.flatnonzero(~easy), parts, general)):
            for k in range(0, len(where), 4096):
                own = where[k : k + 4096]
                ids, counts[own] = how([source[i] for i in own.tolist()])
                made.append(ids)
            order.append(where)
        places = np.concatenate(order)
        starts = np.zeros(len(parts), np.int64)
        starts[places] = np.cumsum(counts[places]) - counts[places]
        return pick_runs(np.concatenate(made), starts, counts), counts

    return encode
