"""Scans and sinks: every sink writes to a fresh folder, and the result is read back from there."""

from decimal import Decimal

from pyspark.sql import functions as F

from rillwork.functions import paths
from rillwork.functions.json_values import pick, record_text
from rillwork.plans import transfers
from rillwork.session import fresh_dir, settle
from rillwork.sinks import append, blobs, landing, members, records as out
from rillwork.sources import files, records, tables
from rillwork.suite.registry import query, table

SHELF = 200  # documents per file; doc_id is unique, so no file holds more


def _shelves(spark, sf, body):
    """Documents as files of at most ``SHELF`` documents, four folders."""
    number = F.floor(F.col("doc_id") / SHELF).cast("long")
    return (
        table(spark, sf, "documents")
        .groupBy(number.alias("shelf"))
        .agg(body.alias("body"))
        .withColumn("path", F.format_string("room%d/shelf_%d.txt", F.col("shelf") % 4, "shelf"))
    )


def _texts_in_order():
    entries = F.sort_array(F.collect_list(F.struct("doc_id", "text")))
    return F.array_join(F.transform(entries, lambda e: e["text"]), "\n--\n")


SHELVES_SQL = """SELECT doc_id // 200 AS shelf, string_agg(text, chr(10) || '--' || chr(10) ORDER BY doc_id) AS body
    FROM documents GROUP BY 1"""


@query(
    "scan_file_listing",
    f"""SELECT 'room' || (shelf % 4) || '/shelf_' || shelf || '.txt' AS path, 'shelf_' || shelf || '.txt' AS name,
        'shelf_' || shelf AS stem, '.txt' AS suffix, octet_length(encode(body)) AS size
    FROM ({SHELVES_SQL}) WHERE shelf % 4 <> 3""",
)
def scan_file_listing(spark, sf):
    base = fresh_dir(spark, "shelves")
    blobs.write_blobs(_shelves(spark, sf, _texts_in_order()), base, "path", "body")
    return files.list_files(spark, base, "**/*.txt", exclude_dirs=["room3"]).drop("modified")


@query(
    "scan_file_blobs",
    f"SELECT 'shelf_' || shelf || '.txt' AS name, octet_length(encode(body)) AS size, sha256(body) AS digest FROM ({SHELVES_SQL})",
)
def scan_file_blobs(spark, sf):
    base = fresh_dir(spark, "shelves")
    blobs.write_blobs(_shelves(spark, sf, _texts_in_order()), base, "path", "body")
    return files.read_blobs(spark, base, "**/*.txt").select("name", "size", F.sha2("data", 256).alias("digest"))


@query(
    "copy_files",
    f"""SELECT 'room' || (shelf % 4) || '/shelf_' || shelf || '.txt' AS path, octet_length(encode(body)) AS size
    FROM ({SHELVES_SQL})""",
)
def copy_files(spark, sf):
    source, target = fresh_dir(spark, "shelves"), fresh_dir(spark, "copied")
    blobs.write_blobs(_shelves(spark, sf, _texts_in_order()), source, "path", "body")
    blobs.copy_files(spark, source, target)
    return files.list_files(spark, target).select("path", "size")


def _json_lines(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return F.array_join(F.collect_list(record_text(documents)), "\n")


@query("compress_copy_files", "SELECT doc_id, text FROM documents")
def compress_copy_files(spark, sf):
    source, packed, opened = (fresh_dir(spark, n) for n in ("shelves", "packed", "opened"))
    blobs.write_blobs(_shelves(spark, sf, _json_lines(spark, sf)), source, "path", "body")
    blobs.compress_files(spark, source, packed, F.concat(F.lit("zz/"), "name", F.lit(".zz")), codec="zlib")
    blobs.decompress_files(spark, packed, opened, F.concat(F.lit("json/"), paths.stem("name"), F.lit(".json")), codec="zlib")
    return records.read_json_lines(spark, f"{opened}/json", "doc_id long, text string")


@query("compress_and_copy", "SELECT doc_id, text FROM documents")
def compress_and_copy(spark, sf):
    source, packed = fresh_dir(spark, "shelves"), fresh_dir(spark, "packed")
    # The names repeat from room to room.
    place = F.concat_ws("/", F.substring_index("path", "/", 1), F.format_string("part_%d.txt", F.floor(F.col("shelf") / 4)))
    blobs.write_blobs(_shelves(spark, sf, _json_lines(spark, sf)).withColumn("path", place), source, "path", "body")
    transfers.compress_and_copy(spark, source, packed, "2024-01-05 00:00:00", "**/*.txt")
    return records.read_json_lines(spark, f"{packed}/2024-01-05/*", "doc_id long, text string")


@query("scan_csv_typed", "SELECT * FROM customer")
def scan_csv_typed(spark, sf):
    customers = table(spark, sf, "customer")
    base = fresh_dir(spark, "csv")
    out.write_csv(customers, base, quote_all=False, delimiter="|")
    return records.read_csv(spark, base, customers.schema, delimiter="|")


@query("scan_csv_skip_rows", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def scan_csv_skip_rows(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    line = F.to_csv(F.struct(*parts.columns))
    head = "made by hand\ntwo lines to skip\np_partkey,p_name,p_size,p_retailprice\n"
    lines = F.array_join(F.collect_list(line), "\n")
    shelves = parts.groupBy(F.floor(F.col("p_partkey") / 1000).alias("n")).agg(lines.alias("lines"))
    base = fresh_dir(spark, "csv")
    path = F.format_string("parts_%d.csv", "n")
    blobs.write_blobs(shelves, base, path, F.concat(F.lit(head), "lines", F.lit("\n")))
    return records.read_csv(spark, base, parts.schema, skip_rows=2)


@query(
    "scan_csv_strings",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
        CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer""",
)
def scan_csv_strings(spark, sf):
    base = fresh_dir(spark, "csv")
    out.write_csv(table(spark, sf, "customer"), base)
    return records.read_csv_strings(spark, base)


@query(
    "scan_json_records",
    "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
)
def scan_json_records(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "props")
    return records.parse_json_column(events, "props", "k int")


def _document_shelf(orient):
    if orient == "records":
        return F.to_json(F.collect_list(F.struct("doc_id", "lang", "text")))
    lists = F.sort_array(F.collect_list(F.struct("doc_id", "lang", "text")))
    return F.to_json(F.struct(*[lists.getField(c).alias(c) for c in ("doc_id", "lang", "text")]))


def _json_documents(spark, sf, orient):
    base = fresh_dir(spark, "documents")
    blobs.write_blobs(_shelves(spark, sf, _document_shelf(orient)), base, "path", "body")
    return records.read_json_documents(spark, base, "doc_id long, lang string, text string", orient)


@query("scan_json_document", "SELECT doc_id, lang, text FROM documents")
def scan_json_document(spark, sf):
    return _json_documents(spark, sf, "records")


@query("scan_json_document_columns", "SELECT doc_id, lang, text FROM documents")
def scan_json_document_columns(spark, sf):
    return _json_documents(spark, sf, "columns")


@query(
    "run_sql_template",
    """SELECT count(*) AS n_rows, min(ts) AS first_at, 'rw_events' AS table_name FROM events
    WHERE ts >= TIMESTAMP '1996-06-01' AND ts < TIMESTAMP '2024-01-15'
    UNION ALL SELECT count(*), min(o_orderdate), 'rw_orders' FROM orders
    WHERE o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderdate < TIMESTAMP '2024-01-15'""",
)
def run_sql_template(spark, sf):
    table(spark, sf, "events").withColumnRenamed("ts", "at").createOrReplaceTempView("rw_events")
    table(spark, sf, "orders").withColumnRenamed("o_orderdate", "at").createOrReplaceTempView("rw_orders")
    text = """SELECT count(*) AS n_rows, min(at) AS first_at FROM IDENTIFIER(:table)
        WHERE at >= to_timestamp_ntz(:start) AND at < to_timestamp_ntz(:end)"""
    values = {"start": "1996-06-01 00:00:00", "end": "2024-01-15 00:00:00"}
    return tables.run_sql_template(spark, text, ["rw_events", "rw_orders"], **values)


@query(
    "write_json_records",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, lower(hex(o_orderstatus)) AS status,
        strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""",
)
def write_json_records(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("decimal(14,2)")).alias("price"),
        F.encode("o_orderstatus", "UTF-8").alias("status"),
        "o_orderdate",
        "o_orderpriority",
    )
    base = fresh_dir(spark, "json")
    out.write_json_records(orders, base, compression="gzip")
    schema = "o_orderkey long, price double, status string, o_orderdate string, o_orderpriority string"
    return records.read_json_lines(spark, base, schema)


def _csv_round_trip(spark, sf, quote_all):
    documents = table(spark, sf, "documents")
    base = fresh_dir(spark, "csv")
    out.write_csv(documents, base, quote_all=quote_all, compression="gzip")
    return records.read_csv(spark, base, documents.schema, multi_line=True)


@query("scan_csv_quoted", "SELECT doc_id, text, lang, source, n_chars FROM documents UNION ALL SELECT doc_id, text, lang, source, -n_chars FROM documents")
def scan_csv_quoted(spark, sf):
    """Texts with line breaks, quotes and commas, in files that each begin with two lines to skip; splits end inside of them."""
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    twice = documents.unionByName(documents.withColumn("n_chars", -F.col("n_chars")))

    def quoted(c: str):
        return F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))

    line = F.concat_ws(",", *[F.coalesce(quoted(c), F.lit("")) for c in documents.columns])
    head = 'made by an "odd program\nin two lines\n' + ",".join(documents.columns) + "\n"
    base = fresh_dir(spark, "quoted")
    # A file per task, so that no task writes all; the lower 33 bits count a task's rows.
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    twice.select(F.when(first, F.concat(F.lit(head), line)).otherwise(line).alias("value")).write.text(base)
    return records.read_csv(spark, base, documents.schema, multi_line=True, skip_rows=2)


@query("write_csv", "SELECT * FROM documents")
def write_csv(spark, sf):
    return _csv_round_trip(spark, sf, quote_all=True)


@query("write_csv_minimal", "SELECT * FROM documents")
def write_csv_minimal(spark, sf):
    return _csv_round_trip(spark, sf, quote_all=False)


@query(
    "compress_in_members",
    """SELECT how, event_type, count(*) AS n_rows, sum(event_id)::BIGINT AS ids, sum(event_id * event_id)::BIGINT AS squares
    FROM events, (VALUES ('by members'), ('as plain gzip')) AS t(how) GROUP BY 1, 2""",
)
def compress_in_members(spark, sf):
    """One file of all events, compressed by many tasks; read by its members, and by a reader that knows gzip only."""
    source, target = fresh_dir(spark, "large"), fresh_dir(spark, "members")
    line = F.concat_ws(",", "event_id", "event_type", "ts", "value", "props")
    table(spark, sf, "events").select(line.alias("value")).coalesce(1).write.text(source)
    members.compress_in_members(spark, source, target, "part-*", size=1 << 16)
    own = members.read_in_members(spark, target).select(F.lit("by members").alias("how"), "value")
    plain = spark.read.text(f"{target}/part-*.gz").select(F.lit("as plain gzip").alias("how"), "value")
    parts = F.split("value", ",")
    rows = own.unionByName(plain).select("how", parts[0].cast("long").alias("event_id"), parts[1].alias("event_type"))
    number = F.col("event_id").cast("decimal(19,0)")
    sums = rows.groupBy("how", "event_type").agg(F.count("*").alias("n_rows"), F.sum(number).alias("ids"), F.sum(number * number).alias("squares"))
    sums = settle(sums, "sums")
    # The sums are exact: BIGINT as in the SQL as long as they fit, else, where the SQL has no result, DECIMAL.
    wide = sums.agg(*[F.coalesce(F.max(F.abs(c)) >= F.lit(Decimal(1 << 63)), F.lit(False)).alias(c) for c in ("ids", "squares")]).first()
    return sums.select("how", "event_type", "n_rows", *[F.col(c).cast("decimal(38,0)" if wide[c] else "long").alias(c) for c in ("ids", "squares")])


@query(
    "append_free_paths",
    """SELECT event_type || '/' || strftime(ts, '%Y-%m-%d') || '.csv' AS path, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id % 2, event_id) AS line_num,
        event_id, event_type FROM events""",
)
def append_free_paths(spark, sf):
    """Lines appended to files named by each row, in two appends; the second one is made twice. Lines stand in the order of
    the appends, then of the events."""
    events, base = table(spark, sf, "events"), fresh_dir(spark, "appended")
    place = F.concat("event_type", F.lit("/"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".csv"))
    line = F.concat_ws(",", "event_id", F.concat("event_type", F.lit("\n")))
    for number in (0, 1, 1):
        append.append_blobs(events.filter(F.col("event_id") % 2 == number), base, place, line, "event_id", number)
    append.fold_appends(spark, base)
    read = spark.read.format("binaryFile").load(f"{base}/[!_]*/*.csv")
    lines = read.select(paths.as_format("path", base, "relative").alias("path"), F.posexplode(F.split(F.rtrim(F.col("content").cast("string"), F.lit("\n")), "\n")).alias("at", "line"))
    parts = F.split("line", ",")
    return lines.select("path", (F.col("at") + 1).cast("long").alias("line_num"), parts[0].cast("long").alias("event_id"), parts[1].alias("event_type"))


@query(
    "write_free_paths",
    """SELECT event_type || '/' || strftime(ts, '%Y/%m/%d') || '.json' AS path, count(*) AS n_rows, sum(event_id)::BIGINT AS ids
    FROM events GROUP BY 1""",
)
def write_free_paths(spark, sf):
    events = table(spark, sf, "events")
    base = fresh_dir(spark, "free")
    place = F.concat("event_type", F.lit("/"), F.date_format("ts", "yyyy/MM/dd"), F.lit(".json"))
    manifest = out.write_to_paths(events, base, place, ["event_id"])
    read = records.read_json_lines(spark, f"{base}/*/*/*", "event_id long, event_type string")
    name = F.col("_metadata.file_path")
    found = read.select("event_id", paths.as_format(name, base, "relative").alias("path")).groupBy("path").agg(F.sum("event_id").alias("ids"))
    return manifest.select("path", "n_rows").join(found, "path")


@query(
    "write_path_template",
    """SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_rows, sum(event_id)::BIGINT AS ids
    FROM events GROUP BY 1, 2""",
)
def write_path_template(spark, sf):
    events = table(spark, sf, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    base = fresh_dir(spark, "by-type-and-day")
    keys = ["event_type", "day"]
    out.write_by_template(events.filter("event_id % 2 = 0"), base, keys)
    out.write_by_template(events.filter("event_id % 2 = 1"), base, keys, append=True)
    written = spark.read.schema(events.schema).parquet(base)
    return written.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum("event_id").alias("ids"))


@query(
    "export_table_chunks",
    """SELECT file_num, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (
        SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 10000 + 1 AS file_num FROM orders) GROUP BY 1""",
)
def export_table_chunks(spark, sf):
    base = fresh_dir(spark, "chunks")
    orders = table(spark, sf, "orders")
    out.write_chunks_csv(orders, base, 10_000, ["o_orderkey"])
    read = records.read_csv(spark, base, orders.schema.add("file_num", "long"))
    return read.groupBy("file_num").agg(
        F.count("*").alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


@query(
    "table_to_files",
    """SELECT 'orders_' || file_num || '.csv' AS path, count(*) AS n_rows, min(o_orderkey) AS first_key FROM (
        SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 10000 + 1 AS file_num FROM orders) GROUP BY 1""",
)
def table_to_files(spark, sf):
    base = fresh_dir(spark, "orders")
    orders = table(spark, sf, "orders")
    transfers.table_to_files(orders, base, "orders", ["o_orderkey"])
    read = records.read_csv(spark, base, orders.schema).withColumn("path", paths.name(F.input_file_name()))
    return read.groupBy("path").agg(F.count("*").alias("n_rows"), F.min("o_orderkey").alias("first_key"))


def _empty_table(spark, df):
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return landing.create_table(spark, "rw_target", columns, fresh_dir(spark, "table"))


@query("load_files_to_table", "SELECT * FROM customer")
def load_files_to_table(spark, sf):
    customers = table(spark, sf, "customer")
    base = fresh_dir(spark, "csv")
    out.write_csv(customers.toDF("a", "b", "c", "d", "e"), base)
    target = _empty_table(spark, customers)
    transfers.files_to_table(spark, base, target)
    return spark.table(target)


def stamped_files(spark, sf, names):
    """Tables as files named after the table and a time, in one folder."""
    base = fresh_dir(spark, "arrivals")
    sources = {n: table(spark, sf, n) for n in names}
    for name, df in sources.items():
        stamped = F.format_string(f"data_{name}_2021-02-18T03_00_%02d_%d.csv", F.col("file_num") % 60, "file_num")
        transfers.table_to_files(df, base, name, [df.columns[0]], 1000, stamped)
    return base, sources


@query(
    "files_to_table",
    """SELECT 'supplier' AS table_name, s_suppkey AS id, s_name AS name FROM supplier
    UNION ALL SELECT 'customer', c_custkey, c_name FROM customer""",
)
def files_to_table(spark, sf):
    base, sources = stamped_files(spark, sf, ("supplier", "customer"))
    targets = {n: _empty_table(spark, df) for n, df in sources.items()}
    transfers.files_to_tables(spark, base, targets)
    suppliers, customers = spark.table(targets["supplier"]), spark.table(targets["customer"])
    return suppliers.select(F.lit("supplier").alias("table_name"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).unionByName(
        customers.select(F.lit("customer").alias("table_name"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    )


@query(
    "reload_interval",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS interval_start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS interval_end,
        event_type, count(*) AS n_rows, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM events GROUP BY ALL
    UNION ALL SELECT TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-05 01:00:00', event_type, count(*),
        CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) FROM events
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-05 01:00:00' GROUP BY ALL""",
)
def reload_interval(spark, sf):
    events = table(spark, sf, "events")
    base = fresh_dir(spark, "landing")
    landing.reload_all(events, base, "ts", "day", F.lit("events"))
    # A day again, then an hour that begins with it: an interval is known by its start and its end.
    again = [("2024-01-05 00:00:00", "2024-01-06 00:00:00"), ("2024-01-05 00:00:00", "2024-01-05 01:00:00")]
    landing.reload_intervals(events, base, "ts", again, F.lit("again"))
    start, end = again[1]
    landing.reload_interval(tables.read_interval(events, "ts", start, end), base, start, end, F.lit("alone"))
    src = F.col("src")
    typed = landing.read_landing(spark, base).select(
        F.col("_interval_start").alias("interval_start"),
        F.col("_interval_end").alias("interval_end"),
        pick(src, "$.event_type").alias("event_type"),
        pick(src, "$.value", "decimal(18,2)").alias("value"),
    )
    return typed.groupBy("interval_start", "interval_end", "event_type").agg(
        F.count("*").alias("n_rows"), F.sum("value").cast("double").alias("total")
    )


@query(
    "table_to_warehouse",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, TIMESTAMP '2024-01-01' AS interval_start, true AS staged FROM orders
    UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, TIMESTAMP '2024-01-02', false FROM orders""",
)
def table_to_warehouse(spark, sf):
    orders = table(spark, sf, "orders")
    base = fresh_dir(spark, "landing")
    stage = f"{fresh_dir(spark, 'staging')}/orders/2024-01-01"
    for _ in range(2):
        transfers.table_to_warehouse(orders, "orders", base, "2024-01-01 00:00:00", "2024-01-02 00:00:00", stage)
    transfers.table_to_warehouse(orders, "orders", base, "2024-01-02 00:00:00", "2024-01-03 00:00:00")
    src = F.col("src")
    return landing.read_landing(spark, base).select(
        pick(src, "$.o_orderkey", "long").alias("o_orderkey"),
        pick(src, "$.o_orderstatus").alias("o_orderstatus"),
        pick(src, "$.o_totalprice", "double").alias("o_totalprice"),
        F.col("_interval_start").alias("interval_start"),
        F.endswith("_loaded_from", F.lit(".gz")).alias("staged"),
    )


@query(
    "copy_into_table",
    """SELECT c_custkey, c_name, c_acctbal, 'load-' || (1 + c_custkey % 2) AS etl_id FROM customer""",
)
def copy_into_table(spark, sf):
    stage, target = fresh_dir(spark, "stage"), fresh_dir(spark, "copied")
    so_far = None
    for day in (1, 2):  # both days stage files of the same names
        rows = table(spark, sf, "customer").filter(F.col("c_custkey") % 2 == day - 1)
        lines = rows.select(F.format_string("customer_part%03d.json.gz", F.col("c_custkey") % 3 + 1).alias("name"), F.col("c_custkey").alias("_id"), record_text(rows).alias("value"))
        blobs.write_gzip_lines(lines, f"{stage}/day{day}")
        landing.copy_into_table(spark, stage, target, f"load-{day}", loaded=so_far)
        so_far = spark.read.schema(landing.STAGED_SCHEMA).parquet(target)
    landing.copy_into_table(spark, stage, target, "load-3", loaded=so_far)
    var = F.col("data_var")
    return spark.read.schema(landing.STAGED_SCHEMA).parquet(target).select(
        pick(var, "$.c_custkey", "long").alias("c_custkey"),
        pick(var, "$.c_name").alias("c_name"),
        pick(var, "$.c_acctbal", "double").alias("c_acctbal"),
        "etl_id",
    )


@query("append_rows", "SELECT * FROM orders")
def append_rows(spark, sf):
    orders = table(spark, sf, "orders")
    base = fresh_dir(spark, "appended")
    for half in (0, 1):
        landing.append_rows(orders.filter(F.col("o_orderkey") % 2 == half), base)
    return spark.read.schema(orders.schema).parquet(base)
