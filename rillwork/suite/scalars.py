"""Column functions."""

from pyspark.sql import functions as F

from rillwork.functions import intervals, paths, urls
from rillwork.functions.json_values import record_text
from rillwork.suite.registry import query, table


@query(
    "url_columns",
    """SELECT 'page' AS kind, page_id AS id, replace(url_encode(url), '%2F', '/') AS quoted, url_decode(url) AS unquoted FROM pages
    UNION ALL SELECT 'document', doc_id, md5(replace(url_encode(text), '%2F', '/')), md5(text) FROM documents""",
)
def url_columns(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.lit("page").alias("kind"),
        F.col("page_id").alias("id"),
        urls.quote("url").alias("quoted"),
        urls.unquote("url").alias("unquoted"),
    )
    documents = table(spark, sf, "documents").select("doc_id", urls.quote("text").alias("quoted"))
    return pages.unionByName(
        documents.select(
            F.lit("document").alias("kind"),
            F.col("doc_id").alias("id"),
            F.md5("quoted").alias("quoted"),
            F.md5(urls.unquote("quoted")).alias("unquoted"),
        )
    )


@query(
    "file_name_columns",
    r"""WITH named AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority,
        '/in/data_' || o_orderstatus || '_x_' || strftime(o_orderdate, '%Y-%m-%dT%H_%M_%S') || '.tar.gz' AS path FROM orders)
    SELECT o_orderkey, string_split(path, '/')[-1] AS name, string_split(string_split(path, '/')[-1], '.')[1] AS stem,
        '.gz' AS suffix, 2 AS n_suffixes, regexp_extract(path, 'data_(.*)_\d{4}-', 1) AS table_name,
        regexp_replace(o_orderpriority, '[^-a-zA-Z0-9]', '_', 'g') AS clean_name,
        translate(o_orderpriority, ' -', '__') AS identifier,
        '/data/erp/' || strftime(o_orderdate, '%Y-%m-%d') || '/part' || (o_custkey % 10) || '.csv' AS lake,
        'orders_part' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '.json.gz' AS part,
        '@staging/' || replace(url_encode(o_orderpriority), '%2F', '/') || '/' || strftime(o_orderdate, '%Y-%m-%d') || '/' AS stage,
        ends_with(o_orderpriority, 'W') AS is_low FROM named""",
)
def file_name_columns(spark, sf):
    day = F.col("o_orderdate").cast("date").cast("string")
    named = table(spark, sf, "orders").withColumn(
        "path",
        F.concat(F.lit("/in/data_"), "o_orderstatus", F.lit("_x_"), intervals.file_stamp("o_orderdate"), F.lit(".tar.gz")),
    )
    return named.withColumn("name", paths.name("path")).select(
        "o_orderkey",
        "name",
        paths.stem("name").alias("stem"),
        paths.suffix("name").alias("suffix"),
        F.size(paths.suffixes("name")).alias("n_suffixes"),
        paths.table_from_path("path").alias("table_name"),
        paths.clean_filename("o_orderpriority").alias("clean_name"),
        paths.clean_identifier("o_orderpriority").alias("identifier"),
        paths.lake_path(F.lit("erp"), day, F.col("o_custkey") % 10, F.lit("csv")).alias("lake"),
        paths.part_name(F.lit("orders"), F.col("o_custkey") % 1000).alias("part"),
        paths.stage_path("o_orderpriority", "o_orderdate").alias("stage"),
        F.endswith("o_orderpriority", F.lit("W")).alias("is_low"),
    )


@query(
    "json_columns",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price,
        strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ordered, lower(hex(o_orderpriority)) AS coded,
        o_orderkey % 5 = 0 AS null_kept, o_orderpriority AS from_line, o_orderpriority AS decoded FROM orders""",
)
def json_columns(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("decimal(14,2)")).alias("price"),
        F.col("o_orderdate").alias("ordered"),
        F.encode("o_orderpriority", "UTF-8").alias("coded"),
    )
    line = F.to_csv(F.struct("o_orderkey", F.decode("coded", "UTF-8").alias("priority")))
    texts = rows.select("o_orderkey", "coded", record_text(rows).alias("j"), line.alias("line"))
    parsed = F.from_json("j", "price double, ordered string, coded string").alias("p")
    back = F.from_csv("line", "o_orderkey bigint, priority string").alias("c")
    return texts.select("o_orderkey", "coded", "j", parsed, back).select(
        "o_orderkey",
        "p.price",
        "p.ordered",
        F.col("p.coded").alias("coded"),
        F.contains("j", F.lit('"price":null')).alias("null_kept"),
        F.col("c.priority").alias("from_line"),
        F.decode(texts["coded"], "UTF-8").alias("decoded"),
    )


@query(
    "interval_columns",
    """SELECT event_id, date_trunc('year', ts)::TIMESTAMP AS at_year, date_trunc('month', ts)::TIMESTAMP AS at_month,
        date_trunc('day', ts)::TIMESTAMP AS at_day, date_trunc('hour', ts)::TIMESTAMP AS at_hour,
        date_trunc('minute', ts)::TIMESTAMP AS at_minute, date_trunc('second', ts)::TIMESTAMP AS at_second,
        strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS iso,
        strftime(ts, '%Y-%m-%dT%H_%M_%S') AS stamp,
        CASE WHEN event_id % 3 = 0 THEN 'latest' ELSE strftime(ts, '%Y-%m-%d') END AS argument FROM events""",
)
def interval_columns(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        *[intervals.truncate("ts", unit).alias(f"at_{unit}") for unit in intervals.UNITS],
        intervals.iso_text("ts").alias("iso"),
        intervals.file_stamp("ts").alias("stamp"),
        intervals.date_argument(F.when(F.col("event_id") % 3 != 0, F.col("ts"))).alias("argument"),
    )
