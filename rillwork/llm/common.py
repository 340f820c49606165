"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows in an Arrow batch: whole texts go to Python, and two batches must fit beside a worker's own memory.
ROWS_PER_BATCH = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Let the session send no more than ``ROWS_PER_BATCH`` rows to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType | str) -> DataFrame:
    """``mapInPandas`` that keeps large integers beside nulls: such a column of a batch comes as ``Int64``, not as floats."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    target = to_arrow_schema(wanted)

    def as_series(values: pa.Array) -> pd.Series:
        whole = pa.types.is_integer(values.type) and values.null_count
        return values.to_pandas(types_mapper=(lambda _: pd.Int64Dtype()) if whole else None, use_threads=False)

    def as_frame(batch: pa.RecordBatch) -> pd.DataFrame:
        return pd.DataFrame({name: as_series(values) for name, values in zip(batch.schema.names, batch.columns, strict=True)})

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(map(as_frame, batches)):  # no batch is held beside its frame
            # Column by column: threads would each keep the memory of the texts that they have converted.
            yield pa.RecordBatch.from_arrays([pa.Array.from_pandas(frame[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(mapped, wanted)


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: whatever else the input has cannot clash."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def shielded(df: DataFrame) -> DataFrame:
    """The same columns under names that no operator uses; ``toDF`` with the old names brings them back."""
    return df.toDF(*[f"column {i}" for i in range(len(df.columns))])


def without(df: DataFrame, *names: str) -> DataFrame:
    """The columns but those that a result of these names takes the place of, upper and lower case alike."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def crc_of(column: str) -> Column:
    """crc32 of a value as text; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def sampled_share(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the key alone: below ``bound / count`` it takes about ``bound`` rows,
    the same rows in any run and without a shuffle."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def pick_runs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]``, one after the other."""
    return flat[np.repeat(starts, lengths) + ranges(lengths)]


def text_slices(texts: list[str | None], limit: int = 1 << 20) -> Iterable[tuple[int, int]]:
    """Spans of rows with about ``limit`` characters each, one row at least."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def groups_of(batches, columns: list[str]):
    """Whole groups from sorted batches: frames whose rows are equal in ``columns`` never straddle two yields.

    The input is partitioned and sorted by these columns. Only the last, unfinished group of a batch is carried over.
    """
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        same = np.ones(len(batch), bool)
        for c in columns:
            values = batch[c].to_numpy()
            same &= values == values[-1]
        cut = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = batch.iloc[cut:]
        if cut:
            yield batch.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """First row of each group in sorted columns."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
