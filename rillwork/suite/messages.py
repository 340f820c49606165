"""Messages with schemas that change midway, made from the events."""

from functools import reduce

from pyspark.sql import functions as F

from rillwork.operators.messages import Decoded
from rillwork.suite.registry import query, table

# A stream per type of event. Every 97th event is preceded by a SCHEMA message of its stream, of three kinds in turn: with the value
# as a number, with it as a whole number and the time beside it, and with the user as text and the properties as an object.
USER, TIME = '"user_id": {"type": ["null", "integer"]}', '"at": {"type": "string", "format": "date-time"}'
SCHEMAS = [
    f'{{"type": "object", "properties": {{{USER}, "value": {{"type": "number"}}}}}}',
    f'{{"type": "object", "properties": {{{USER}, "value": {{"type": "integer"}}, {TIME}}}}}',
    '{"type": "object", "properties": {"user_id": {"type": "string"}, "value": {"type": "number"}, "props": {"type": "object"}}}',
]
BOUND_SQL = """WITH schemas AS (SELECT event_type AS stream, event_id * 10 AS version, (event_id // 97) % 3 AS kind FROM events WHERE event_id % 97 = 0),
    bound AS (SELECT e.*, s.version, s.kind FROM events e ASOF JOIN schemas s ON s.stream = e.event_type AND s.version <= e.event_id * 10 + 5),
    decoded AS (SELECT event_type AS stream, event_id * 10 + 5 AS message, version, CAST(user_id AS VARCHAR) AS user_id,
        CASE WHEN kind <> 1 OR value % 1 = 0 THEN value END AS value, CASE WHEN kind = 1 THEN ts END AS at,
        CASE WHEN kind = 2 THEN replace(props, ' ', '') END AS props FROM bound)"""


def _messages(spark, sf):
    events = table(spark, sf, "events")
    at, props = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), F.from_json("props", "k long").alias("props")
    record = F.struct(F.lit("RECORD").alias("type"), F.col("event_type").alias("stream"), F.struct("user_id", "value", at, props).alias("record"))
    records = events.select((F.col("event_id") * 10 + 5).alias("message"), F.to_json(record).alias("text"))
    text = F.element_at(F.array(*[F.lit(s) for s in SCHEMAS]), (F.floor(F.col("event_id") / 97) % 3 + 1).cast("int"))
    head = F.concat(F.lit('{"type": "SCHEMA", "stream": "'), F.col("event_type"), F.lit('", "key_properties": ["user_id"], "schema": '), text, F.lit("}"))
    schemas = events.filter("event_id % 97 = 0").select((F.col("event_id") * 10).alias("message"), head.alias("text"))
    state = F.to_json(F.struct(F.lit("STATE").alias("type"), F.struct("event_id").alias("value")))
    states = events.filter("event_id % 50 = 1").select((F.col("event_id") * 10 + 7).alias("message"), state.alias("text"))
    return Decoded(records.unionByName(schemas).unionByName(states), "text", "message")


def _all_streams(out, frames):
    columns = {"user_id": "string", "value": "double", "at": "timestamp_ntz", "props": "string"}
    parts = []
    for stream in out.streams():
        df = frames(stream)
        values = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
        parts.append(df.select(F.lit(stream).alias("stream"), F.col("_order").alias("message"), F.col("_version").alias("version"), *values))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("decode_messages", BOUND_SQL + " SELECT * FROM decoded")
def decode_messages(spark, sf):
    """Every record in the types of the schema before it."""
    out = _messages(spark, sf)
    return _all_streams(out, out.records)


@query(
    "upsert_messages",
    BOUND_SQL + " SELECT * FROM decoded QUALIFY row_number() OVER (PARTITION BY stream, user_id ORDER BY message DESC) = 1",
)
def upsert_messages(spark, sf):
    """The last record per stream and key."""
    out = _messages(spark, sf)
    return _all_streams(out, out.latest)


@query(
    "unbound_messages",
    """SELECT event_type AS stream, event_id * 10 + 5 AS message FROM events e
    WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = e.event_type AND s.event_id % 97 = 0 AND s.event_id <= e.event_id)""",
)
def unbound_messages(spark, sf):
    """Records before the first schema of their stream."""
    return _messages(spark, sf).unbound().select("stream", F.col("_order").alias("message"))
