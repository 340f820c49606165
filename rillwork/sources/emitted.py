"""User functions without input as sources: each emits batches for the units of work it names.

A function lists its units (files, pages, days: texts in ascending order) and emits batches for one of them. Units are
Spark's partitions, so they run apart and a lost one runs again. As a stream, the last unit read is the offset: a run goes on after it.
Simple conditions of a query reach the function, which may list fewer units for them; Spark applies them again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Conditions by column: (sign, value), the sign one of =, <, <=, >, >=, in.
Conditions = dict[str, list[tuple[str, Any]]]
Units = Callable[[Conditions], Iterable[str]]
Batch = pa.RecordBatch | pd.DataFrame | list[dict]
Emit = Callable[[str], Iterable[Batch]]

SIGNS = {ds.EqualTo: "=", ds.LessThan: "<", ds.LessThanOrEqual: "<=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.In: "in"}


def as_record_batch(batch: Batch, schema: pa.Schema) -> pa.RecordBatch:
    if isinstance(batch, pd.DataFrame):
        return pa.RecordBatch.from_pandas(batch[schema.names], schema=schema, preserve_index=False)
    if isinstance(batch, pa.RecordBatch):
        return batch.select(schema.names).cast(schema)
    return pa.RecordBatch.from_pylist(batch, schema=schema)


def conditions_of(filters: Iterable[ds.Filter]) -> Conditions:
    """Those of the filters that compare a column of its own with values."""
    out: Conditions = {}
    for f in filters:
        if type(f) in SIGNS and len(f.attribute) == 1:
            out.setdefault(f.attribute[0], []).append((SIGNS[type(f)], f.value))
    return out


def allows(conditions: list[tuple[str, Any]], least: Any, most: Any) -> bool:
    """Whether values from ``least`` to ``most`` can meet all conditions."""
    tests = {
        "=": lambda v: least <= v <= most, "<": lambda v: least < v, "<=": lambda v: least <= v,
        ">": lambda v: most > v, ">=": lambda v: most >= v, "in": lambda v: any(least <= x <= most for x in v),
    }
    return all(tests[sign](value) for sign, value in conditions)


def register_emitter(spark: SparkSession, name: str, schema: str, units: Units, emit: Emit) -> None:
    """Make the function known as the format ``name``: ``spark.read.format(name).load()``, or ``readStream``.

    ``units`` must give texts whose ascending order is the order of arrival; for a stream no unit may appear below one that
    was read. ``emit`` gives the batches of a unit: record batches, frames, or lists of dicts.
    """
    fields = T.StructType.fromDDL(schema)
    target = to_arrow_schema(fields)
    if str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")) != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def batches(unit: str) -> Iterator[pa.RecordBatch]:
        for batch in emit(unit):
            yield as_record_batch(batch, target)

    class Reader(ds.DataSourceReader):
        def __init__(self):
            self.conditions: Conditions = {}

        def pushFilters(self, filters):
            self.conditions = conditions_of(filters)
            yield from filters  # hints only: Spark still applies all of them

        def partitions(self):
            return [ds.InputPartition(u) for u in units(self.conditions)]

        def read(self, partition):
            yield from batches(partition.value) if partition else ()

    class StreamReader(ds.DataSourceStreamReader):
        def initialOffset(self):
            return {"after": ""}

        def latestOffset(self):
            return {"after": max(units({}), default="")}

        def partitions(self, start, end):
            return [ds.InputPartition(u) for u in units({}) if start["after"] < u <= end["after"]]

        def read(self, partition):
            yield from batches(partition.value) if partition else ()

    class Emitter(ds.DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return fields

        def reader(self, schema):
            return Reader()

        def streamReader(self, schema):
            return StreamReader()

    spark.dataSource.register(Emitter)
