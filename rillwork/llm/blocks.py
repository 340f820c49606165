"""Token ids as files of patched frame-of-reference blocks.

A block holds 1024 ids: its minimum is subtracted, the rest is packed at the width that the stated share of the block
needs, and the few larger values keep their high bits in an exception list. A file is a header, the blocks, the start of
every block, and an index of the documents; any block can be read alone. Files follow the order of doc_id.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import map_frames, renamed, text_slices
from rillwork.llm.tokens import library_memory
from rillwork.session import fresh_dir, settle
from rillwork.storage import open_path

BLOCK, SHARE, MAGIC = 1024, 0.9, b"PFOR1\0\0\0"
#: Magic, partition, ids of the partition before this file, ids, documents, blocks.
HEADER = struct.Struct("<8sQQQQQ")
#: Minimum, width, exceptions.
HEAD = struct.Struct("<IHH")
#: Ids after which a file ends with its document.
FILE_IDS = 1 << 20


def packed_size(width: int) -> int:
    return BLOCK * width // 8


def pack(ids: np.ndarray, share: float = SHARE) -> list[bytes]:
    """Blocks of the ids; the last one is filled up with its own minimum."""
    out: list[bytes] = []
    for k in range(0, len(ids), BLOCK * 256):
        some = ids[k : k + BLOCK * 256].astype(np.int64)
        count = -(-len(some) // BLOCK)
        rest = count * BLOCK - len(some)
        some = np.concatenate([some, np.full(rest, some[(count - 1) * BLOCK :].min())]).reshape(count, BLOCK)
        least = some.min(axis=1)
        some -= least[:, None]
        bits = np.frexp(some.astype(np.float64))[1]
        widths = np.sort(bits, axis=1)[:, int(share * (BLOCK - 1))]
        made: list[bytes] = [b""] * count
        for width in np.unique(widths):
            own = np.flatnonzero(widths == width)
            low = np.unpackbits(some[own].astype("<u4").reshape(-1, 1).view(np.uint8), axis=1, bitorder="little")[:, :width]
            body = np.packbits(low.reshape(len(own), BLOCK * width), axis=1, bitorder="little")
            for row, data in zip(own, body, strict=True):
                at = np.flatnonzero(some[row] >> width)
                high = some[row, at] >> width
                made[row] = HEAD.pack(least[row], width, len(at)) + data.tobytes() + at.astype("<u2").tobytes() + high.astype("<u4").tobytes()
        out += made
    return out


def unpack_block(data: memoryview) -> np.ndarray:
    least, width, exceptions = HEAD.unpack_from(data)
    at = HEAD.size + packed_size(width)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, packed_size(width), HEAD.size), bitorder="little")
    full = np.zeros((BLOCK, 32), np.uint8)
    full[:, :width] = bits.reshape(BLOCK, width)
    out = np.packbits(full, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)
    places = np.frombuffer(data, "<u2", exceptions, at)
    out[places] |= np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions).astype(np.int64) << width
    return out + least


def to_file(partition: int, before: int, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of whole documents. A null doc_id is marked by its place in the list at the end."""
    made = pack(ids)
    starts = HEADER.size + np.cumsum([0, *map(len, made)])
    nulls = np.flatnonzero(pd.isna(doc_ids))
    plain = np.array([0 if pd.isna(d) else d for d in doc_ids], "<i8")
    tail = [starts.astype("<u8"), plain, counts.astype("<u8"), nulls.astype("<u8")]
    head = HEADER.pack(MAGIC, partition, before, len(ids), len(doc_ids), len(made))
    return b"".join([head, *made, *[x.tobytes() for x in tail], struct.pack("<Q", len(nulls)), struct.pack("<Q", starts[-1])])


class TokenFile:
    """A file's bytes, read block by block."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.partition, self.before, self.n_ids, docs, blocks = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of token blocks")
        at = struct.unpack_from("<Q", data, len(data) - 8)[0]
        nulls = struct.unpack_from("<Q", data, len(data) - 16)[0]
        self.starts = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.doc_ids = np.frombuffer(data, "<i8", docs, at + 8 * (blocks + 1)).astype(object)
        self.counts = np.frombuffer(data, "<u8", docs, at + 8 * (blocks + 1 + docs)).astype(np.int64)
        self.doc_ids[np.frombuffer(data, "<u8", nulls, at + 8 * (blocks + 1 + 2 * docs)).astype(np.int64)] = None

    def block(self, k: int) -> np.ndarray:
        own = unpack_block(self.data[self.starts[k] : self.starts[k + 1]])
        return own[: self.n_ids - k * BLOCK] if k == len(self.starts) - 2 else own

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids from ``start`` on: only the blocks that hold them are decoded."""
        if not count:
            return np.zeros(0, np.int64)
        first, last = start // BLOCK, (start + count - 1) // BLOCK
        return np.concatenate([self.block(k) for k in range(first, last + 1)])[start - first * BLOCK :][:count]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the partition before it, ids); a block is decoded once or twice."""
        at = 0
        held, first = np.zeros(0, np.int64), 0
        for doc_id, count in zip(self.doc_ids, self.counts, strict=True):
            if at + count > first + len(held):
                blocks = range((first + len(held)) // BLOCK, max((at + count - 1) // BLOCK + 1, min((at // BLOCK) + 64, len(self.starts) - 1)))
                held = np.concatenate([held[at - first :], *[self.block(k) for k in blocks]])
                first = at
            yield doc_id, self.before + at, held[at - first :][:count]
            at += int(count)


MANIFEST = T.StructType([T.StructField("name", T.StringType()), T.StructField("partition", T.LongType()), T.StructField("n_ids", T.LongType())])


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", special: bool = False
) -> DataFrame:
    """Encode whole texts with the library's vocabulary at ``path`` (strings of its special tokens as these tokens if
    ``special``, else as ordinary text), append ``end_id`` to each, and write the files.

    Returns the written manifest: a row per file with its partition and its number of ids. Rows are range-partitioned
    and sorted by doc_id (null first) before they are encoded, once; rows of one doc_id follow their text's order. A
    null or empty text has the end id alone; an empty table writes nothing; other columns are not read. A file appears
    under its name only when it is whole, and a repeated task writes the same bytes again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        memory, partition = library_memory(path, special), TaskContext.get().partitionId()
        names, sizes, before = [], [], 0
        doc_ids, counts, ids, held = [], [], [], 0

        def flush() -> None:
            nonlocal doc_ids, counts, ids, held, before
            if not doc_ids:
                return
            name = f"part-{partition:06d}-{len(names):06d}.pfor"
            data = to_file(partition, before, np.concatenate(doc_ids), np.concatenate(counts), np.concatenate(ids))
            system, base = open_path(folder)
            system.create_dir(base, recursive=True)
            hidden = f"{base}/_{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as out:
                out.write(data)
            system.move(hidden, f"{base}/{name}")
            names.append(name)
            sizes.append(held)
            before += held
            doc_ids, counts, ids, held = [], [], [], 0

        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            keys = batch["doc_id"].to_numpy(object)
            for a, b in text_slices(texts):
                flat, n = memory.ids(texts[a:b])
                out = np.full(len(flat) + len(n), end_id, np.uint32)
                out[np.repeat(np.arange(len(n)), n) + np.arange(len(flat))] = flat
                doc_ids.append(keys[a:b])
                counts.append(n + 1)
                ids.append(out)
                held += len(out)
                if held >= FILE_IDS:
                    flush()
        flush()
        yield pd.DataFrame({"name": names, "partition": [partition] * len(names), "n_ids": sizes})

    own = renamed(docs, doc_id=doc_id, text=text)
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return settle(map_frames(ordered, run, MANIFEST), "manifest")


ROWS = T.StructType([T.StructField("partition", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("local", T.LongType()),
                     T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files in the manifest. The ids of all documents
    before one are those of earlier partitions (a sum over one row per partition) and those before it in its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                file = TokenFile(data)
                rows = [(file.partition, d, at, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, at, x in file.documents()]
                yield pd.DataFrame(rows, columns=ROWS.names, dtype=object)

    totals = manifest.groupBy("partition").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("partition", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.pfor").load(folder).select("content")
    decoded = map_frames(files, run, ROWS)
    return decoded.join(bases, "partition").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(
    docs: DataFrame, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", special: bool = False
) -> DataFrame:
    """``write_tokens`` into a new folder of the shared scratch space, then ``read_documents``; an empty table has no rows."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "tokens")
    manifest = write_tokens(docs, folder, path, end_id, doc_id, text, special)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_documents(spark, folder, manifest)
