"""Streaming jobs over the given tables. Each run processes what is there and stops."""

from pyspark.sql import functions as F

from rillwork.functions.json_values import pick, record_text
from rillwork.session import fresh_dir
from rillwork.operators.flow import union_inputs
from rillwork.sources.files import list_files
from rillwork.streaming import bookmarks, ingest, reload, state
from rillwork.suite.files import stamped_files
from rillwork.suite.registry import query, table


def _events(spark, sf):
    """The event table as a stream. The pattern makes a single file acceptable as a folder would be."""
    return ingest.stream_files(spark, f"{sf}/events.parque[t]", table(spark, sf, "events").schema)


def _batches(spark, sf, parts=3):
    """The events out of order in so many micro-batches."""
    base = fresh_dir(spark, "arrivals")
    arrivals = table(spark, sf, "events").withColumn("arrival", F.pmod(F.xxhash64("event_id"), F.lit(parts)))
    arrivals.write.partitionBy("arrival").parquet(base)
    files = list_files(spark, base, "**/part-*").count()
    return ingest.stream_files(spark, base, arrivals.schema, pattern="part-*", files_per_batch=-(-files // parts)).drop("arrival")


@query("stream_file_ingest", "SELECT * FROM events")
def stream_file_ingest(spark, sf):
    path, checkpoint = fresh_dir(spark, "ingested"), fresh_dir(spark, "checkpoint")
    for _ in range(2):
        ingest.ingest(_events(spark, sf), path, checkpoint)
    return spark.read.schema(table(spark, sf, "events").schema).parquet(path)


@query(
    "stream_csv_to_tables",
    """SELECT 'supplier' AS table_name, s_suppkey AS id, s_acctbal AS acctbal FROM supplier
    UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer""",
)
def stream_csv_to_tables(spark, sf):
    base, sources = stamped_files(spark, sf, ("supplier", "customer"))
    schemas = {n: df.schema for n, df in sources.items()}
    targets = {n: fresh_dir(spark, n) for n in sources}
    ingest.ingest_csv_tables(spark, base, targets, schemas, fresh_dir(spark, "checkpoint"))
    loaded = {n: spark.read.schema(schemas[n]).parquet(targets[n]) for n in sources}
    suppliers = loaded["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"))
    customers = loaded["customer"].select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"))
    return union_inputs({"supplier": suppliers, "customer": customers}, column="table_name")


@query(
    "stream_interval_reload",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS interval_start, count(*) AS n_rows, sum(event_id)::BIGINT AS ids
    FROM events GROUP BY 1""",
)
def stream_interval_reload(spark, sf):
    path, schema, base = fresh_dir(spark, "reloaded"), table(spark, sf, "events").schema, fresh_dir(spark, "arrivals")
    table(spark, sf, "events").repartition(3, "event_id").write.parquet(base)
    for per_batch in (1, 2):  # again with a new checkpoint and other batches: nothing changes
        arrivals = ingest.stream_files(spark, base, schema, files_per_batch=per_batch)
        reload.reload_from_stream(arrivals, path, fresh_dir(spark, "checkpoint"), "ts")
    rows = reload.read_reloaded(spark, path, schema)
    return rows.groupBy(F.col("_interval_start").alias("interval_start")).agg(
        F.count("*").alias("n_rows"), F.sum("event_id").alias("ids")
    )


@query(
    "stream_reload_late",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS interval_start, event_type, count(*) AS n_rows, sum(event_id)::BIGINT AS ids
    FROM events GROUP BY 1, 2""",
)
def stream_reload_late(spark, sf):
    """Late files seen by a run with a new checkpoint of its own add rows to their intervals, before and after compaction."""
    path, schema = fresh_dir(spark, "reloaded"), table(spark, sf, "events").schema
    late = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for k in range(3):
        base = fresh_dir(spark, f"arrivals-{k}")
        table(spark, sf, "events").filter(late == k).write.parquet(base)
        reload.reload_from_stream(ingest.stream_files(spark, base, schema), path, fresh_dir(spark, "checkpoint"), "ts")
        if k != 1:
            reload.compact_reloaded(spark, path, schema)
    rows = reload.read_reloaded(spark, path, schema)
    return rows.groupBy(F.col("_interval_start").alias("interval_start"), "event_type").agg(F.count("*").alias("n_rows"), F.sum("event_id").alias("ids"))


@query(
    "stream_schedule_agg",
    """SELECT 'week' AS schedule, (date_trunc('day', ts) - to_days(dayofweek(ts)::INTEGER))::TIMESTAMP AS interval_start,
        (date_trunc('day', ts) - to_days(dayofweek(ts)::INTEGER) + INTERVAL 7 DAY)::TIMESTAMP AS interval_end, count(*) AS n_rows, max(value) AS top
    FROM events GROUP BY 2, 3
    UNION ALL SELECT 'month', date_trunc('month', ts)::TIMESTAMP, (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP, count(*), max(value)
    FROM events GROUP BY 2, 3""",
)
def stream_schedule_agg(spark, sf):
    """Calendar weeks and months on a stream whose rows come in no order."""
    parts = {}
    for name, schedule in (("week", "@weekly"), ("month", "@monthly")):
        counted = state.scheduled_stream(_batches(spark, sf), "ts", schedule, F.count("*").alias("n_rows"), F.max("value").alias("top"), delay="400 days")
        path, keys = fresh_dir(spark, "schedule"), ["interval_start", "interval_end"]
        state.write_changes(counted, path, fresh_dir(spark, "checkpoint"), keys)
        parts[name] = state.read_current(spark, path, counted.schema, keys)
    return union_inputs(parts, column="schedule")


@query(
    "stream_route",
    "SELECT event_id, event_type AS route FROM events WHERE event_type IN ('click', 'view', 'purchase')",
)
def stream_route(spark, sf):
    path = fresh_dir(spark, "routed")
    ingest.route_stream(
        _events(spark, sf), path, fresh_dir(spark, "checkpoint"), ["click", "view", "purchase"], "event_type"
    )
    return spark.read.parquet(path).select("event_id", "route")


LATEST_SQL = """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(props, (ts, event_id)) AS props,
    max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1"""


@query("latest_state", LATEST_SQL)
def latest_state(spark, sf):
    values = ["event_type", "props", "ts", "event_id"]
    return state.latest_state(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], values)


@query("stream_latest_state", LATEST_SQL)
def stream_latest_state(spark, sf):
    values = ["event_type", "props", "ts", "event_id"]
    latest = state.latest_state(_batches(spark, sf), ["user_id"], ["ts", "event_id"], values)
    path = fresh_dir(spark, "states")
    state.write_changes(latest, path, fresh_dir(spark, "checkpoint"), ["user_id"])
    return state.read_current(spark, path, latest.schema, ["user_id"])


@query(
    "stream_tumbling_agg",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS interval_start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS interval_end,
        count(*) AS n_rows, max(value) AS top FROM events GROUP BY 1, 2""",
)
def stream_tumbling_agg(spark, sf):
    # The arrivals are in no order: rows are late by up to the whole span of the table.
    daily = state.tumbling_stream(
        _batches(spark, sf), "ts", "1 day", F.count("*").alias("n_rows"), F.max("value").alias("top")
    )
    path = fresh_dir(spark, "windows")
    state.write_changes(daily, path, fresh_dir(spark, "checkpoint"), ["interval_start", "interval_end"])
    return state.read_current(spark, path, daily.schema, ["interval_start", "interval_end"])


@query(
    "stream_topic_source",
    "SELECT user_id::VARCHAR AS key, event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
)
def stream_topic_source(spark, sf):
    topic, path = fresh_dir(spark, "topic"), fresh_dir(spark, "read")
    events = table(spark, sf, "events")
    value = F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "props": '), "props", F.lit("}"))
    events.select(F.col("user_id").cast("string").alias("key"), value.alias("value")).write.parquet(topic)
    messages = ingest.topic_source(spark, "parquet", schema="key string, value string", path=topic)
    parsed = messages.select("key", F.from_json("value", "event_id long, props struct<k: int>").alias("m"))
    ingest.ingest(parsed.select("key", "m.event_id", "m.props.k"), path, fresh_dir(spark, "checkpoint"))
    return spark.read.schema("key string, event_id long, k int").parquet(path)


@query(
    "stream_topic_sink",
    "SELECT event_id::VARCHAR AS key, user_id, event_type FROM events",
)
def stream_topic_sink(spark, sf):
    topic = fresh_dir(spark, "topic")
    events = _events(spark, sf).select("event_id", "user_id", "event_type")
    ingest.topic_sink(
        events, F.col("event_id"), record_text(events), fresh_dir(spark, "checkpoint"), "json", path=topic
    )
    sent = spark.read.schema("key string, value string").json(topic).withColumn("v", F.parse_json("value"))
    return sent.select(
        "key",
        pick(F.col("v"), "$.user_id", "long").alias("user_id"),
        pick(F.col("v"), "$.event_type").alias("event_type"),
    )


@query(
    "bookmark_extract",
    """SELECT event_id, event_type, ts, CASE WHEN ts < TIMESTAMP '2024-01-09' THEN 1 WHEN ts < TIMESTAMP '2024-01-18' THEN 2 ELSE 3 END AS run
    FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-03-01'""",
)
def bookmark_extract(spark, sf):
    """Three extracts, each from the bookmark that the one before left, and a fourth one that finds nothing more."""
    source, states, path, checkpoint, out = (fresh_dir(spark, n) for n in ("daily", "states", "bookmarks", "checkpoint", "extracted"))
    schema = "stream string, bookmark string"
    table(spark, sf, "events").withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(source)
    daily = spark.read.parquet(source)
    for run, last in enumerate(("2024-01-08", "2024-01-17", "2024-02-29", "2024-02-29"), start=1):
        known = spark.createDataFrame([], bookmarks.BOOKMARKS) if run == 1 else bookmarks.read_bookmarks(spark, path)
        rows = bookmarks.extract_after(daily, known, "events", "day", "2024-01-01", last)
        rows.select("event_id", "event_type", "ts", F.lit(run).alias("run")).write.parquet(f"{out}/{run}")
        state = [("events", last), ("events", "2024-01-02"), ("other", last)]  # one comes late
        spark.createDataFrame(state, schema).write.mode("append").parquet(states)
        bookmarks.keep_bookmarks(ingest.stream_files(spark, states, schema), path, checkpoint)
    return spark.read.parquet(*[f"{out}/{n}" for n in range(1, 5)])
