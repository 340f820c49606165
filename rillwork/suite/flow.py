"""Filter, split, route, branch, explode, number."""

from pyspark.sql import functions as F

from rillwork.functions import extensions
from rillwork.functions.json_values import pick_each, pick_each_fields, pick_fields, pick_list, pick_where, search
from rillwork.operators import batches, flow
from rillwork.suite.registry import query, table


@query(
    "filter_rows",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
    WHERE l_quantity > 25 AND l_discount >= 0.05 AND l_returnflag = 'R'""",
)
def filter_rows(spark, sf):
    wanted = (F.col("l_quantity") > 25) & (F.col("l_discount") >= 0.05) & (F.col("l_returnflag") == "R")
    kept = flow.filter_rows(table(spark, sf, "lineitem"), wanted)
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    "split_if_then",
    """SELECT c_custkey, CASE WHEN coalesce(bal > 0, false) THEN 'then' ELSE 'otherwise' END AS route
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)""",
)
def split_if_then(spark, sf):
    balance = F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal"))
    customers = table(spark, sf, "customer").withColumn("balance", balance)
    outputs = flow.split_if_then(customers, F.col("balance") > 0)
    return flow.branch_tables({n: df.select("c_custkey") for n, df in outputs.items()}, column="route")


@query(
    "branch_rows",
    """SELECT b.segment, b.priority, count(*) AS n_rows
    FROM (VALUES ('BUILDING', 1), ('MACHINERY', 2), ('HOUSEHOLD', 3)) b(segment, priority)
    JOIN customer ON c_mktsegment = b.segment GROUP BY 1, 2""",
)
def branch_rows(spark, sf):
    items = [("BUILDING", 1), ("MACHINERY", 2), ("HOUSEHOLD", 3)]
    branches = flow.branch_rows(spark, items, "segment string, priority int")
    per_segment = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n_rows"))
    # The literal list is as long as the line above: safe to broadcast.
    return per_segment.join(F.broadcast(branches), F.col("c_mktsegment") == F.col("segment")).select(
        "segment", "priority", "n_rows"
    )


@query(
    "branch_tables",
    """SELECT 'customer' AS table_name, count(*) AS n_rows FROM customer
    UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem""",
)
def branch_tables(spark, sf):
    tables = {n: table(spark, sf, n) for n in ("customer", "orders", "events", "lineitem")}
    return flow.branch_tables(tables, lambda df: df.agg(F.count("*").alias("n_rows")))


@query(
    "route_by_type",
    """SELECT event_type AS route, count(*) AS n_rows, max(event_id) AS last_id FROM events
    WHERE event_type IN ('click', 'view', 'purchase') GROUP BY event_type""",
)
def route_by_type(spark, sf):
    routed = flow.branch_tables(flow.route_by_type(table(spark, sf, "events"), ["click", "view", "purchase"], "event_type"), column="route")
    return routed.groupBy("route").agg(F.count("*").alias("n_rows"), F.max("event_id").alias("last_id"))


@query(
    "fan_out",
    """WITH shared AS (SELECT l_suppkey, l_returnflag, sum(CAST(l_quantity AS BIGINT)) AS qty
        FROM lineitem GROUP BY 1, 2)
    SELECT 'by_flag' AS branch, l_returnflag AS item, CAST(sum(qty) AS BIGINT) AS qty FROM shared GROUP BY 2
    UNION ALL
    SELECT 'by_supplier', CAST(l_suppkey AS VARCHAR), CAST(sum(qty) AS BIGINT) FROM shared GROUP BY 2""",
)
def fan_out(spark, sf):
    lines = table(spark, sf, "lineitem")
    shared = lines.groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    parts = flow.fan_out(
        shared,
        {
            "by_flag": lambda df: df.groupBy(F.col("l_returnflag").alias("item")).agg(F.sum("qty").alias("qty")),
            "by_supplier": lambda df: df.groupBy(F.col("l_suppkey").cast("string").alias("item")).agg(
                F.sum("qty").alias("qty")
            ),
        },
    )
    return flow.union_inputs(parts, column="branch")


@query(
    "union_inputs",
    """SELECT s_name AS name, s_nationkey AS nationkey, 'supplier' AS source FROM supplier
    UNION ALL SELECT c_name, c_nationkey, 'customer' FROM customer""",
)
def union_inputs(spark, sf):
    suppliers = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"))
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"))
    return flow.union_inputs({"supplier": suppliers, "customer": customers})


@query(
    "json_search",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS missing,
        u.item AS item
    FROM events, (VALUES (1), (2)) AS v(i),
        LATERAL (SELECT CASE v.i WHEN 1 THEN event_type ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS item) u""",
)
def json_search(spark, sf):
    events = table(spark, sf, "events")
    text = F.concat(
        F.lit('{"props": '), "props", F.lit(', "tags": ["'), "event_type", F.lit('", "'),
        F.get_json_object("props", "$.k"), F.lit('"]}'),
    )
    found = events.select("event_id", text.alias("text"))
    for path, kind, alias in (("$.props.k", "int", "k"), ("$.props.none", "string", "missing"), ("$.tags", "string", "item")):
        found = search(found, "text", path, kind, alias, explode_lists=alias == "item")
    return found.drop("text")


@query(
    "json_search_shapes",
    """WITH parts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
            CASE WHEN l_discount > 0.05 THEN CAST(round(l_discount * 100) AS BIGINT) END AS cents FROM lineitem),
        documents_ AS (SELECT l_orderkey, first(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, cents NULLS FIRST) AS first_part,
            string_agg(CAST(cents AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_quantity, cents NULLS FIRST) AS discounts,
            count(*) FILTER (l_quantity >= 40) AS n_large FROM parts GROUP BY l_orderkey)
    SELECT o_orderkey AS order_key, o_orderstatus AS status, first_part, o_orderkey || '|' || o_orderstatus AS pair,
        coalesce(discounts, '') AS discounts, CAST(n_large AS INTEGER) AS n_large, l_partkey AS part, l_quantity AS quantity
    FROM orders JOIN documents_ d ON o_orderkey = d.l_orderkey JOIN parts p ON o_orderkey = p.l_orderkey""",
)
def json_search_shapes(spark, sf):
    """Named fields, a list of fields, one field of each element, elements that meet a condition, fields of each element."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    cents = F.when(F.col("l_discount") > 0.05, F.round(F.col("l_discount") * 100).cast("long"))
    entry = F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), cents.alias("cents"))
    texts = (
        lines.groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sort_array(F.collect_list(entry)).alias("lines"))
        .join(orders, "o_orderkey")
        .select(F.to_json(F.struct(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("order"), "lines")).alias("text"))
    )
    doc = texts.select(F.parse_json("text").alias("doc"))
    v = F.col("doc")
    shaped = doc.select(
        pick_fields(v, {"order_key": ("$.order.key", "long"), "status": ("$.order.status", "string"), "first_part": ("$.lines[0].part", "long")}).alias("named"),
        F.array_join(pick_list(v, ["$.order.key", "$.order.status"]), "|").alias("pair"),
        F.array_join(pick_each(v, "$.lines", "$.cents"), ",").alias("discounts"),
        F.size(pick_where(v, "$.lines", "$.quantity", "double", lambda q: q >= 40)).alias("n_large"),
        pick_each_fields(v, "$.lines", {"part": ("$.part", "long"), "quantity": ("$.quantity", "double")}).alias("picked"),
    )
    # Exploded in a step of its own: beside an explode, Spark would pick the other shapes again for each of a document's lines.
    # The outer one, as for the other Spark would parse the texts twice, first to drop documents without lines.
    lines = shaped.select("named", "pair", "discounts", "n_large", F.explode_outer("picked").alias("line")).filter(F.col("line").isNotNull())
    return lines.select("named.*", "pair", "discounts", "n_large", "line.*")


@query(
    "explode_response",
    """SELECT doc_id, CAST(item_num AS BIGINT) AS item_num, line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) AS item_num FROM documents)""",
)
def explode_response(spark, sf):
    documents = table(spark, sf, "documents")
    return flow.explode_response(documents, F.split("text", "\n"), "line", keep=["doc_id"])


@query(
    "flatten_rates",
    """SELECT event_type AS base, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n,
        CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total
    FROM events GROUP BY 1, 2""",
)
def flatten_rates(spark, sf):
    # One response per base with a map of days: one entry per interval, whatever the number of events.
    daily = (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("base"), F.col("ts").cast("date").cast("string").alias("date"))
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    )
    entry = F.struct("date", F.struct("n", "total"))
    responses = daily.groupBy("base").agg(F.map_from_entries(F.collect_list(entry)).alias("rates"))
    return flow.flatten_rates(responses)


@query(
    "multi_step",
    """SELECT p_partkey, p_size + 2 AS a, p_size + 2 + 10 AS b, CAST(round((p_size + 2 + 10) * p_retailprice, 2) AS DOUBLE) AS c
    FROM part""",
)
def multi_step(spark, sf):
    return flow.multi_step(
        table(spark, sf, "part"),
        lambda df: df.withColumn("a", F.col("p_size") + 2),
        lambda df: df.withColumn("b", F.col("a") + 10),
        lambda df: df.withColumn("c", F.round(F.col("b") * F.col("p_retailprice"), 2)),
        lambda df: df.select("p_partkey", "a", "b", "c"),
    )


@query(
    "carry_metadata",
    """SELECT o_orderkey, 'orders' AS table_name, '@staging/orders/1998-01-01/' AS stage_location,
        'orders' AS from_file FROM orders""",
)
def carry_metadata(spark, sf):
    rows = flow.carry_metadata(
        table(spark, sf, "orders").select("o_orderkey"),
        file_column="file",
        table_name="orders",
        stage_location="@staging/orders/1998-01-01/",
    )
    return rows.withColumn("from_file", F.regexp_extract("file", r"([^/]+)\.parquet", 1)).drop("file")


@query(
    "chunk_rows",
    """SELECT o_orderstatus, o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 100 + 1
        AS batch_num FROM orders""",
)
def chunk_rows(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey")
    return batches.chunk_rows(orders, 100, ["o_orderstatus"], ["o_orderkey"])


@query(
    "batch_summary",
    """SELECT o_orderstatus, count(*) AS n_rows, CAST(ceil(count(*) / 100.0) AS BIGINT) AS n_batches
    FROM orders GROUP BY 1""",
)
def batch_summary(spark, sf):
    return batches.batch_summary(table(spark, sf, "orders"), 100, ["o_orderstatus"])


@query(
    "number_batches",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS batch_num
    FROM events""",
)
def number_batches(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return batches.number_rows(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "order_batches",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS batch_num
    FROM events ORDER BY user_id, batch_num""",
)
def order_batches(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id")
    return batches.order_batches(batches.number_rows(events, ["user_id"], ["event_id"]), ["user_id"])


@query(
    "limit_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3""",
)
def limit_per_key(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return batches.limit_per_key(orders, ["o_custkey"], ["o_orderkey"], 3)


@query(
    "schedule_gate",
    """SELECT event_id, CASE WHEN isodow(ts) = 1 THEN 'archive' ELSE 'normal' END AS route FROM events""",
)
def schedule_gate(spark, sf):
    return flow.schedule_gate(table(spark, sf, "events"), "ts", 1, "archive", "normal").select("event_id", "route")


@query(
    "rename_by_position",
    """SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS state, o_totalprice AS price,
        o_orderdate AS ordered, o_orderpriority AS priority FROM orders""",
)
def rename_by_position(spark, sf):
    names = ["id", "customer", "state", "price", "ordered", "priority"]
    return flow.rename_by_position(table(spark, sf, "orders"), names)


@query("apply_function", "SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS squared FROM lineitem")
def apply_function(spark, sf):
    squared = (F.col("l_quantity") * F.col("l_quantity")).alias("squared")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", squared)


@query(
    "udtf_emit_items",
    """SELECT p_partkey, CAST(item_num AS INTEGER) AS item_num, item FROM (
        SELECT p_partkey, unnest(string_split(p_name, ' ')) AS item,
            generate_subscripts(string_split(p_name, ' '), 1) AS item_num FROM part)""",
)
def udtf_emit_items(spark, sf):
    extensions.register_emit_items(spark, "emit_items")
    words = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return spark.sql("SELECT p_partkey, item_num, item FROM {words}, LATERAL emit_items(words)", words=words)


@query(
    "udtf_running_batches",
    """SELECT user_id, event_type, batch_num, n_rows, total, CAST(sum(total) OVER (PARTITION BY user_id, event_type ORDER BY batch_num) AS BIGINT) AS running FROM (
        SELECT user_id, event_type, (rn - 1) // 10 + 1 AS batch_num, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS total FROM (
            SELECT user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
                row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) GROUP BY ALL)""",
)
def udtf_running_batches(spark, sf):
    """A function of a table: batches of ten rows per user and type in the order of time, with running totals."""
    extensions.register_running_batches(spark, "running_batches")
    events = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    call = "running_batches(TABLE(SELECT * FROM {events}) PARTITION BY (user_id, event_type) ORDER BY (ts, event_id), size => 10, value => 'cents', keep => 'user_id, event_type')"
    return spark.sql(f"SELECT * FROM {call}", events=events)


@query(
    "udf_on_column",
    "SELECT o_orderkey, o_totalprice * 1.25 + 3 AS grossed FROM orders",
)
def udf_on_column(spark, sf):
    gross = extensions.column_function(lambda s: s * 1.25 + 3, "double")
    return table(spark, sf, "orders").select("o_orderkey", gross("o_totalprice").alias("grossed"))


@query(
    "map_batches",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem""",
)
def map_batches(spark, sf):
    def revenue(batch):
        out = batch[["l_orderkey", "l_linenumber"]].copy()
        out["revenue"] = batch["l_extendedprice"] * (1 - batch["l_discount"])
        return out

    lines = table(spark, sf, "lineitem")
    needed = lines.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return extensions.map_batches(needed, revenue, "l_orderkey long, l_linenumber int, revenue double")
