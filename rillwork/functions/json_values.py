"""Records to JSON text and back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.functions.intervals import iso_text

KEEP_NULLS = {"ignoreNullFields": "false"}


def _plain(dtype: T.DataType) -> bool:
    """Whether Spark's JSON text of the type is already the wanted one."""
    if isinstance(dtype, T.StructType):
        return all(_plain(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _plain(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _plain(dtype.valueType)
    return not isinstance(dtype, (T.DecimalType, T.BinaryType, T.TimestampType, T.TimestampNTZType, T.DateType))


def json_safe(col: Column, dtype: T.DataType) -> Column:
    """Decimal as double, bytes as hex text, dates and times as ISO text, at any depth."""
    if _plain(dtype):
        return col
    if isinstance(dtype, T.DecimalType):
        return col.cast("double")
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(col))
    if isinstance(dtype, T.DateType):
        return col.cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: json_safe(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: json_safe(v, dtype.valueType))
    fields = [json_safe(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
    return F.when(col.isNotNull(), F.struct(*fields))


def safe_columns(df: DataFrame) -> DataFrame:
    """The frame with every column in its JSON-safe type."""
    return df.select(*[json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _record(df: DataFrame, columns: list[str] | None = None) -> Column:
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return F.struct(*[json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])


def record_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One JSON object per row; nulls are kept."""
    return F.to_json(_record(df, columns), KEEP_NULLS)


def record_variant(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The same object as a variant, without the detour over text."""
    return F.to_variant_object(_record(df, columns))


def pick(variant: Column, path: str, as_type: str = "string") -> Column:
    """Value at a JSON path (``$.a.b[0]``); null where the path is missing."""
    return F.try_variant_get(variant, path, as_type)


def pick_each(variant: Column, path: str, field: str, as_type: str = "string") -> Column:
    """One field of every element of a list, elements without the field left out."""
    items = F.try_variant_get(variant, path, "array<variant>")
    return F.filter(F.transform(items, lambda x: F.try_variant_get(x, field, as_type)), lambda x: x.isNotNull())


def pick_fields(variant: Column, fields: dict[str, tuple[str, str]]) -> Column:
    """A struct of named paths: ``{"k": ("$.k", "int")}``."""
    return F.struct(*[pick(variant, path, as_type).alias(n) for n, (path, as_type) in fields.items()])


def pick_list(variant: Column, paths: Sequence[str], as_type: str = "string") -> Column:
    """A list of the values at several paths, null where one is missing."""
    return F.array(*[pick(variant, path, as_type) for path in paths])


def pick_each_fields(variant: Column, path: str, fields: dict[str, tuple[str, str]]) -> Column:
    """The same struct of named paths from every element of a list; null if there is no list."""
    return F.transform(F.try_variant_get(variant, path, "array<variant>"), lambda x: pick_fields(x, fields))


def pick_where(variant: Column, path: str, field: str, as_type: str, condition: Callable[[Column], Column]) -> Column:
    """The elements of a list, as variants, whose field meets a condition; elements without it go."""
    items = F.try_variant_get(variant, path, "array<variant>")
    return F.filter(items, lambda x: F.coalesce(condition(F.try_variant_get(x, field, as_type)), F.lit(False)))


def items_of(variant: Column, path: str) -> Column:
    """The found value as list of variants, ready for ``explode``: a list gives its elements, another
    value one element, and a missing value one null."""
    items = F.try_variant_get(variant, path, "array<variant>")
    return F.coalesce(items, F.array(F.try_variant_get(variant, path, "variant")))


def search(
    df: DataFrame, column: str, path: str, as_type: str = "string", alias: str = "item", explode_lists: bool = True
) -> DataFrame:
    """Project a JSON text column by a path; one row per element of a list result."""
    variant = F.parse_json(column)
    if not explode_lists:
        return df.withColumn(alias, pick(variant, path, as_type))
    items = df.withColumn(alias, F.explode(items_of(variant, path)))
    return items.withColumn(alias, pick(F.col(alias), "$", as_type))
