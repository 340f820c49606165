"""Quality rules on word counts and zstandard ratios.

A text that repeats itself compresses to a small share of its bytes, random or encoded bytes hardly at all. How far
natural text shrinks depends on its length, as a longer one offers more earlier text to refer to, so the limits depend on
it too. They are put to the whole text and to its fixed chunks: the whole finds what is repeated far apart, the chunks
find long runs of junk inside a text whose other parts are fine.

Beside these stand plain counts of words, symbols, repeated lines and repeated runs of three words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Compressed bytes by bytes at level 3: (bytes below which the row holds, least ratio, largest ratio). Natural prose
#: stands near 0.6 at 500 bytes, near 0.45 at 5,000 and near 0.4 at 50,000; scripts of three bytes a letter shrink less
#: when short. A line repeated ten times is at 0.15, encoded random bytes are above 0.75.
BANDS = ((512, 0.30, 0.90), (1024, 0.28, 0.82), (4096, 0.25, 0.76), (16384, 0.20, 0.72), (1 << 62, 0.15, 0.70))
LEVEL = 3
#: Bytes in a chunk; the last one of a text has the rest as well, so it is up to twice as long.
CHUNK = 4096
#: A text goes if a larger share of its chunks than this is outside the limits.
MOST_BAD_CHUNKS = 0.34

# Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50

SPACE = bytes([32, 9, 10, 11, 12, 13])
LATER_BYTES = bytes(range(0x80, 0xC0))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_chunks", "n_low_chunks", "n_high_chunks")


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more."""
    windows = list(zip(*(words[i:] for i in range(window))))
    if len(set(windows)) == len(windows):
        return 0
    found, inside = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if found[w] > 1:
            inside[i : i + window] = repeat(1, window)
    return sum(inside)


def plain_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in them, symbols, lines with a word equal to an earlier line, words in repeated windows.
    ``bytes`` takes just the six white-space characters of ASCII for space."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    n_chars = len(text.translate(None, SPACE + LATER_BYTES))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), n_chars, n_symbols, len(lines) - len(set(lines)), repeated_words(words)


def limits(n: int, bands: Sequence[tuple[int, float, float]] = BANDS) -> tuple[float, float]:
    """The least and the largest ratio of a text of ``n`` bytes."""
    return next((low, high) for below, low, high in bands if n < below)


def chunks_of(text: bytes, size: int = CHUNK) -> Iterator[memoryview]:
    """Pieces of ``size`` bytes, the last one with the rest."""
    view, n = memoryview(text), max(1, len(text) // size)
    for i in range(n):
        yield view[i * size : (i + 1) * size if i < n - 1 else len(text)]


def measure_texts(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), chunk: int = CHUNK, level: int = LEVEL) -> DataFrame:
    """The columns in ``keep`` with the counts of ``COUNTS`` and ``ratio``, compressed bytes by bytes.

    A null or empty text has counts of 0 and a null ratio. Every row is measured for itself, repeated ones and ones
    without a number too, whole texts of any length, one at a time; an empty table has no rows. A kept column that has
    the name of a result gives way to it; other columns are not read. Kept values do not pass through Python objects.
    """
    kept = [c for c in keep if c not in (*COUNTS, "ratio")]
    source = docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text}`"].cast("string").cast("binary").alias("measured text "))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("ratio", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            rows, ratios = [], []
            for value in batch.column(len(kept)):
                data = value.as_py() or b""
                low = high = n_chunks = 0
                for part in chunks_of(data, chunk) if data else ():
                    least, most = limits(len(part))
                    share = len(packer.compress(part)) / len(part)
                    low, high, n_chunks = low + (share < least), high + (share > most), n_chunks + 1
                rows.append((*plain_counts(data), len(data), n_chunks, low, high))
                ratios.append(len(packer.compress(data)) / len(data) if data else None)
            counts = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *counts, pa.array(ratios, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def within_bands(n_bytes: str = "n_bytes", ratio: str = "ratio", most_bad: float = MOST_BAD_CHUNKS) -> Column:
    """Whether the ratios of a whole text and of its chunks are inside their limits; false for empty texts."""
    out = F.lit(False)
    for below, low, high in reversed(BANDS):
        out = F.when(F.col(n_bytes) < below, F.col(ratio).between(low, high)).otherwise(out)
    bad = (F.col("n_low_chunks") + F.col("n_high_chunks")) <= most_bad * F.col("n_chunks")
    return F.coalesce(out & bad, F.lit(False))


def judge_texts(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``measure_texts`` with ``base_failed`` (too few words, or too many of them in repeated windows) and ``kept``: false
    if ``base_failed``, else whether the ratios are inside their limits. For odd rows see ``measure_texts``; a null or
    empty text fails. Kept columns named like these two give way to them."""
    measured = measure_texts(docs, text, [c for c in keep if c not in ("base_failed", "kept")])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & within_bands())
