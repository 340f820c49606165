"""Messages RECORD, SCHEMA and STATE of many streams: records decoded by the schema that holds for them.

A schema holds for the records of its stream that come after it, until the next one. Messages are cut into ranges of their
order; within a range the last schema is carried forward, and what a range begins with comes from one row per
range and stream. So a stream that holds most of the messages is still many ranges.

A value that does not fit the type that its own schema names is null. A property whose type changes from schema to schema gets a
column that holds all of them: whole numbers and others together are numbers, anything else is text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.session import fresh_dir, settle

MESSAGE = "type string, stream string, schema string, key_properties array<string>, record map<string,string>, value string"
SCHEMA = "properties map<string,struct<type:string,format:string>>"
#: Types of JSON schemas and the column types that hold them; objects and lists stay JSON text.
COLUMNS = {"integer": "bigint", "number": "double", "boolean": "boolean", "timestamp": "timestamp_ntz", "date": "date", "string": "string", "json": "string"}


def read_messages(df: DataFrame, message: str, order: str) -> DataFrame:
    """_order and the fields of each message. Text that is no message has a null type."""
    parsed = df.select(F.col(order).cast("long").alias("_order"), F.from_json(message, MESSAGE).alias("m"))
    return parsed.select("_order", "m.*")


def kind_of(declared: Column, form: Column) -> Column:
    """The one type besides null that a property is declared with; several ones are text, but for the two of numbers."""
    names = F.array_distinct(F.regexp_extract_all(declared, F.lit("[a-z]+"), F.lit(0)))
    own = F.array_sort(F.filter(names, lambda n: n != "null"))
    one = F.array_join(own, " ")
    plain = F.when(form == "date-time", "timestamp").when(form == "date", "date").otherwise("string")
    return F.when(one == "string", plain).when(one.isin("integer", "number", "boolean"), one).when(one == "integer number", "number").when(
        one.isin("object", "array", "array object"), "json"
    ).otherwise("string")


def schema_versions(messages: DataFrame) -> DataFrame:
    """stream, _version (the order of the message), kinds by property, key_properties of every SCHEMA message."""
    own = messages.filter((F.col("type") == "SCHEMA") & F.col("stream").isNotNull())
    parsed = own.select("stream", F.col("_order").alias("_version"), "key_properties", F.from_json("schema", SCHEMA).alias("s"))
    kinds = F.transform_values("s.properties", lambda _, p: kind_of(p["type"], p["format"]))
    return parsed.select("stream", "_version", F.coalesce(kinds, F.expr("CAST(map() AS map<string,string>)")).alias("kinds"), "key_properties")


def bind_schemas(messages: DataFrame) -> DataFrame:
    """RECORD messages with _version, the order of the last SCHEMA message of their stream before them; null if there is none.

    ``_order`` must be unique. The ranges are written sorted; windows are over one stream of one range.
    """
    spark = messages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = messages.filter(F.col("type").isin("RECORD", "SCHEMA")).select("_order", "type", "stream", "record")
    ranged = own.repartitionByRange(parts, "_order").withColumn("_range", F.spark_partition_id())
    ranged = settle(ranged, "messages")
    changes = ranged.filter("type = 'SCHEMA'").groupBy("_range", "stream").agg(F.max("_order").alias("last"))
    touched = ranged.select("_range", "stream").distinct().join(changes, ["_range", "stream"], "left")
    earlier = Window.partitionBy("stream").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = touched.select("_range", "stream", F.max("last").over(earlier).alias("_carried"))
    carried = settle(carried.filter("_carried IS NOT NULL"), "carried")
    within = Window.partitionBy("_range", "stream").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("type") == "SCHEMA", F.col("_order"))).over(within)
    filled = ranged.withColumn("_last", last).filter("type = 'RECORD' AND stream IS NOT NULL")
    return filled.join(carried, ["_range", "stream"], "left").select("_order", "stream", "record", F.coalesce("_last", "_carried").alias("_version"))


def merged_kind(kinds: Sequence[str]) -> str:
    """The kind of a column that holds values of all these kinds."""
    if len(set(kinds)) == 1:
        return kinds[0]
    return "number" if set(kinds) == {"integer", "number"} else "string"


def typed(prop: str, kind: str) -> Column:
    """The property's value if it fits the kind that its own schema names, in the column of ``kind``."""
    value, own = F.col("record")[prop], F.col("kinds")[prop]
    moment = value.try_cast("timestamp")
    fits = (
        F.when(own == "integer", value.rlike(r"^-?[0-9]+(\.0+)?$"))
        .when(own == "number", value.try_cast("double").isNotNull())
        .when(own == "boolean", value.isin("true", "false"))
        .when(own == "timestamp", moment.isNotNull())
        .when(own == "date", value.try_cast("date").isNotNull())
        .otherwise(own.isNotNull())
    )
    held = F.when(fits, moment if kind == "timestamp" else value)
    return (held.cast("timestamp_ntz") if kind == "timestamp" else held.try_cast(COLUMNS[kind])).alias(prop)


class Decoded:
    """Records bound to their schemas, written by stream, so that a stream's frame reads its own folder only."""

    def __init__(self, df: DataFrame, message: str, order: str):
        self.spark = df.sparkSession
        messages = read_messages(df, message, order)
        self.versions = settle(schema_versions(messages), "versions")
        self.path = fresh_dir(self.spark, "bound")
        bound = bind_schemas(messages).join(self.versions, ["stream", "_version"], "left")
        bound.hint("rebalance", "stream").write.partitionBy("stream").parquet(self.path)
        self.schema = bound.schema
        # As many rows as the streams have properties and types.
        listed = self.versions.select("stream", F.explode("kinds").alias("prop", "kind")).groupBy("stream", "prop").agg(F.collect_set("kind").alias("kinds"))
        self.kinds: dict[str, dict[str, str]] = {r.stream: {} for r in self.versions.select("stream").distinct().collect()}
        for row in listed.orderBy("stream", "prop").collect():
            self.kinds[row.stream][row.prop] = merged_kind(row.kinds)

    def bound(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def unbound(self) -> DataFrame:
        """_order, stream and record of the records before any schema of their stream."""
        return self.bound().filter("_version IS NULL").select("_order", "stream", "record")

    def records(self, stream: str, *keep: str) -> DataFrame:
        """_order, _version and a typed column per property of the stream's schemas. Properties that the schema of a
        record does not name are null."""
        own = self.bound().filter((F.col("stream") == stream) & F.col("_version").isNotNull())
        return own.select("_order", "_version", *keep, *[typed(p, k) for p, k in self.kinds[stream].items()])

    def latest(self, stream: str) -> DataFrame:
        """The last record per key of the stream, by the key properties that its schema names; records of schemas without keys are
        all kept. One aggregation with partial maxima, so that a key with most of the rows costs no more than others."""
        rows = self.records(stream, "record", "key_properties")
        parts = F.transform("key_properties", lambda k: F.coalesce(F.concat(F.char_length(F.col("record")[k]).cast("string"), F.lit(":"), F.col("record")[k]), F.lit("-")))
        key = F.when(F.size("key_properties") > 0, F.array_join(parts, "")).otherwise(F.concat(F.lit("#"), F.col("_order").cast("string")))
        columns = ["_order", "_version", *self.kinds[stream]]
        last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), "_order").alias("last")
        return rows.groupBy(key.alias("key")).agg(last).select("last.*")

    def streams(self) -> list[str]:
        return list(self.kinds)
