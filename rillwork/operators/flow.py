"""Filter, split, route, branch, fan out and merge."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.functions.intervals import iso_weekday
from rillwork.session import settle

Step = Callable[[DataFrame], DataFrame]


def truthy(condition: Column) -> Column:
    """A condition that is false where it is null."""
    return F.coalesce(condition, F.lit(False))


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition holds. ``WHERE`` drops null conditions by itself, so the plain
    predicate is used: wrapped in ``coalesce`` it would not be pushed to the scan."""
    return df.filter(condition)


def label_routes(df: DataFrame, routes: dict[str, Column], default: str | None = None, column: str = "route") -> DataFrame:
    """Name the route of each row: the first condition that holds, else ``default``.

    One pass and no copy of the input: written with ``partitionBy(column)`` all outputs come from a
    single scan. Without a default, rows that match nothing vanish.
    """
    label = reduce(
        lambda acc, item: F.when(item[1], F.lit(item[0])) if acc is None else acc.when(item[1], F.lit(item[0])),
        routes.items(),
        None,
    )
    if default is not None:
        return df.withColumn(column, label.otherwise(F.lit(default)))
    return df.withColumn(column, label).filter(F.col(column).isNotNull())


def split_if_then(df: DataFrame, condition: Column) -> dict[str, DataFrame]:
    """Two outputs; a null condition goes to ``otherwise``."""
    return {"then": df.filter(condition), "otherwise": df.filter(~truthy(condition))}


def route_by_type(df: DataFrame, kinds: Sequence[str], type_column: str = "type") -> dict[str, DataFrame]:
    """One output per message type; other types vanish."""
    return {kind: df.filter(F.col(type_column) == F.lit(kind)) for kind in kinds}


def branch_rows(spark: SparkSession, items: Sequence[Any], schema: str | T.StructType) -> DataFrame:
    """A literal sequence as one row per item, made inside the JVM. Its size is the length of the
    program text."""
    fields = (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields
    rows = []
    for item in items:
        values = [item[f.name] for f in fields] if isinstance(item, dict) else item
        values = values if isinstance(values, (tuple, list)) else (values,)
        rows.append(F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, fields, strict=True)]))
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def branch_tables(tables: dict[str, DataFrame], step: Step | None = None, column: str = "table_name") -> DataFrame:
    """The same step for every table of a list; rows carry the name of their table."""
    parts = [(step(df) if step else df).withColumn(column, F.lit(n)) for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_inputs(inputs: dict[str, DataFrame], column: str = "source") -> DataFrame:
    """Several inputs as one, duplicates kept, with the name of the input."""
    return branch_tables(inputs, column=column)


def fan_out(df: DataFrame, branches: dict[str, Step], keep: bool = True) -> dict[str, DataFrame]:
    """The same rows to every branch.

    ``keep`` writes the shared input once, so that every branch sees the same rows and a costly
    upstream is not run again; lost executors cannot lose it as they would lose cached blocks. Switch
    it off when the input is a plain scan of immutable files: there a second pruned scan costs less
    than a copy.
    """
    shared = settle(df, "fan-out") if keep else df
    return {name: step(shared) for name, step in branches.items()}


def explode_response(df: DataFrame, items: str | Column, alias: str = "item", keep: Sequence[str] = ()) -> DataFrame:
    """One row per element of a list inside a response, numbered from 1 and tagged with the request."""
    return df.select(*keep, F.posexplode(items).alias("pos", alias)).withColumn(
        "item_num", (F.col("pos") + 1).cast("long")
    ).drop("pos")


def flatten_rates(df: DataFrame, rates: str = "rates", scalars: Sequence[str] = ("base",), key: str = "date") -> DataFrame:
    """A map of structs as flat rows. The scalars and the map key win over symbols of the same name."""
    exploded = df.select(*scalars, F.explode(rates).alias(key, "symbols"))
    symbols = exploded.schema["symbols"].dataType.fieldNames()
    kept = [F.col(f"symbols.`{s}`").alias(s) for s in symbols if s not in (*scalars, key)]
    return exploded.select(*kept, *scalars, key)


def carry_metadata(df: DataFrame, file_column: str | None = None, **values: Any) -> DataFrame:
    """Side values as literal columns, and the path of the file a row was read from."""
    if file_column:
        df = df.withColumn(file_column, F.input_file_name())
    return df.withColumns({n: F.lit(v) for n, v in values.items()})


def schedule_gate(df: DataFrame, ts: str, weekday: int, matched: str, other: str, column: str = "route") -> DataFrame:
    """Name path A or B by the ISO weekday of the run date."""
    return label_routes(df, {matched: iso_weekday(ts) == F.lit(weekday)}, default=other, column=column)


def rename_by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Column names by position; a wrong count is an error."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns but {len(names)} names")
    return df.toDF(*names)


def multi_step(df: DataFrame, *steps: Step) -> DataFrame:
    """Ordered steps, each on the result of the one before."""
    return reduce(lambda acc, step: acc.transform(step), steps, df)
