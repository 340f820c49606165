"""User code: functions that emit items (UDTF), column functions (pandas UDF), functions on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class EmitItems:
    """Yield every element of a list with its 1-based number."""

    def eval(self, items: list[str]) -> Iterator[tuple[int, str]]:
        if items is not None:
            yield from enumerate(items, start=1)


def register_emit_items(spark: SparkSession, name: str = "emit_items") -> None:
    """Make the item-emitting function known to SQL: ``LATERAL emit_items(col)``."""
    spark.udtf.register(name, udtf(EmitItems, returnType="item_num INT, item STRING"))


def column_function(fn: Callable[[pd.Series], pd.Series], return_type: str) -> Callable[..., Column]:
    """A vectorised user function on columns. Use only where no built-in expression does the work."""

    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield fn(batch)

    call.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(call, return_type)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame | Iterable[pd.DataFrame]], schema: str) -> DataFrame:
    """Apply a function to every Arrow batch of rows; a generator may give several frames per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pd.DataFrame):
                yield out
            else:
                yield from out

    return df.mapInPandas(run, schema)


class RunningBatches:
    """A function of a table, called once per group with the group's rows in order: every ``size`` rows it emits one, and
    at the end of the group one for the rest. It keeps a few numbers between rows, not the rows.

    ``running_batches(TABLE(t) PARTITION BY k ORDER BY ts, size => 10, value => 'amount', keep => 'k')``: the columns
    in ``keep`` (comma-separated), batch_num, n_rows, total of ``value`` in the batch, and running, its total so far in the group.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, value: AnalyzeArgument, keep: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table")
        if not size.isConstantExpression or size.value is None or size.value < 1:
            raise ValueError("size must be a positive constant")
        given = {f.name: f for f in rows.dataType.fields}
        names = [*(n.strip() for n in keep.value.split(",") if n.strip()), value.value]
        unknown = [n for n in names if n not in given]
        if unknown:
            raise ValueError(f"no columns {unknown}, there are {list(given)}")
        whole = isinstance(given[value.value].dataType, T.IntegralType)
        if not whole and not isinstance(given[value.value].dataType, T.NumericType):
            raise ValueError(f"{value.value} is not a number")
        schema = T.StructType([T.StructField(n, given[n].dataType) for n in names[:-1]])
        schema = schema.add("batch_num", T.LongType()).add("n_rows", T.LongType())
        for name in ("total", "running"):
            schema = schema.add(name, T.LongType() if whole else T.DoubleType())
        return AnalyzeResult(schema=schema)

    def __init__(self):
        self.kept, self.batch, self.rows, self.total, self.running, self.names = (), 0, 0, 0, 0, None

    def eval(self, rows: Row, size: int, value: str, keep: str) -> Iterator[tuple]:
        if self.names is None:
            self.names = [n.strip() for n in keep.split(",") if n.strip()]
        self.kept = tuple(rows[n] for n in self.names)
        self.rows += 1
        self.total += rows[value] or 0
        if self.rows == size:
            yield self.emitted()

    def emitted(self) -> tuple:
        self.batch, self.running = self.batch + 1, self.running + self.total
        out = (*self.kept, self.batch, self.rows, self.total, self.running)
        self.rows = self.total = 0
        return out

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield self.emitted()


def register_running_batches(spark: SparkSession, name: str = "running_batches") -> None:
    """Make ``RunningBatches`` known to SQL."""
    spark.udtf.register(name, udtf(RunningBatches))
