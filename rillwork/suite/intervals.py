"""Intervals: extract, ticks, calendars, tumbling aggregates, and the flagship daily load."""

from pyspark.sql import functions as F

from rillwork.functions.intervals import interval_tick, with_previous_interval
from rillwork.operators import intervals
from rillwork.operators.flow import union_inputs
from rillwork.plans.daily import landed_per_type
from rillwork.sources.tables import read_interval
from rillwork.suite.registry import query, table

TICKS = {
    "hourly": ("@hourly", "date_trunc('hour', moment)"),
    "daily": ("@daily", "date_trunc('day', moment)"),
    "weekly": ("@weekly", "date_trunc('week', moment + INTERVAL 1 DAY) - INTERVAL 1 DAY"),
    "monthly": ("@monthly", "date_trunc('month', moment)"),
    "quarterly": ("@quarterly", "date_trunc('quarter', moment)"),
    "yearly": ("@yearly", "date_trunc('year', moment)"),
    "minutes_45": ("rate(45 minutes)", "date_trunc('hour', moment) + to_minutes((minute(moment) // 45) * 45)"),
    "hours_5": ("rate(5 hours)", "date_trunc('day', moment) + to_hours((hour(moment) // 5) * 5)"),
    "days_2": ("rate(2 days)", "date_trunc('month', moment) + to_days(CAST(((day(moment) - 1) // 2) * 2 AS INTEGER))"),
}
MOMENTS_SQL = """(SELECT 'event' AS kind, event_id AS id, ts AS moment FROM events
    UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders)"""


def _moments(spark, sf):
    events = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("moment"))
    orders = table(spark, sf, "orders").select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment")
    )
    return events.unionByName(orders)


@query(
    "scan_interval",
    """SELECT event_id AS id, 'events' AS source FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'
    UNION ALL SELECT o_orderkey, 'orders' FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-04-01'""",
)
def scan_interval(spark, sf):
    events = read_interval(table(spark, sf, "events"), "ts", "2024-01-05 00:00:00", "2024-01-06 00:00:00")
    orders = read_interval(table(spark, sf, "orders"), "o_orderdate", "1997-03-01 00:00:00", "1997-04-01 00:00:00")
    return events.select(F.col("event_id").alias("id"), F.lit("events").alias("source")).unionByName(
        orders.select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("source"))
    )


@query(
    "interval_tick",
    f"SELECT kind, id, {', '.join(f'CAST({sql} AS TIMESTAMP) AS {n}' for n, (_, sql) in TICKS.items())} FROM {MOMENTS_SQL}",
)
def ticks(spark, sf):
    columns = [interval_tick("moment", schedule).alias(n) for n, (schedule, _) in TICKS.items()]
    return _moments(spark, sf).select("kind", "id", *columns)


# Length of the interval before a tick, as SQL.
LENGTHS = {
    "daily": "INTERVAL 1 DAY",
    "weekly": "INTERVAL 7 DAY",
    "quarterly": "INTERVAL 3 MONTH",
    "minutes_45": "CASE WHEN minute(moment) >= 45 THEN INTERVAL 45 MINUTE ELSE INTERVAL 15 MINUTE END",
}
PREVIOUS_SQL = ", ".join(
    f"CAST({TICKS[n][1]} - {length} AS TIMESTAMP) AS {n}_interval_start, CAST({TICKS[n][1]} AS TIMESTAMP) AS {n}_interval_end"
    for n, length in LENGTHS.items()
)


@query("previous_interval", f"SELECT kind, id, {PREVIOUS_SQL} FROM {MOMENTS_SQL}")
def previous_interval(spark, sf):
    moments = _moments(spark, sf)
    for name in LENGTHS:
        moments = with_previous_interval(moments, "moment", TICKS[name][0], f"{name}_")
    return moments.drop("moment")


@query(
    "interval_calendar",
    """WITH seen AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS d, count(*) AS n FROM orders GROUP BY 1),
    days AS (SELECT unnest(generate_series((SELECT min(d) FROM seen), (SELECT max(d) FROM seen), INTERVAL 1 DAY)) AS interval_start)
    SELECT interval_start, interval_start + INTERVAL 1 DAY AS interval_end, coalesce(n, 0) AS n_rows
    FROM days LEFT JOIN seen ON d = interval_start""",
)
def calendar(spark, sf):
    orders = table(spark, sf, "orders")
    return intervals.interval_calendar(orders, "o_orderdate", "day", F.count("*").alias("n_rows")).na.fill(0, ["n_rows"])


@query(
    "tumbling_interval_agg",
    """SELECT '45min' AS schedule, s::TIMESTAMP AS interval_start,
        (CASE WHEN minute(s) = 0 THEN s + INTERVAL 45 MINUTE ELSE s + INTERVAL 15 MINUTE END)::TIMESTAMP AS interval_end, n_rows, top
    FROM (SELECT date_trunc('hour', ts) + CASE WHEN minute(ts) >= 45 THEN INTERVAL 45 MINUTE ELSE INTERVAL 0 MINUTE END AS s,
        count(*) AS n_rows, max(value) AS top FROM events GROUP BY 1)
    UNION ALL SELECT 'week', (date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY)::TIMESTAMP,
        (date_trunc('week', ts + INTERVAL 1 DAY) + INTERVAL 6 DAY)::TIMESTAMP, count(*), max(value) FROM events GROUP BY 2, 3
    UNION ALL SELECT 'month', date_trunc('month', ts)::TIMESTAMP, (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP,
        count(*), max(value) FROM events GROUP BY 2, 3""",
)
def tumbling(spark, sf):
    schedules = {"45min": "rate(45 minutes)", "week": "@weekly", "month": "@monthly"}
    events = table(spark, sf, "events")
    parts = {n: intervals.tumbling(events, "ts", s, F.count("*").alias("n_rows"), F.max("value").alias("top")) for n, s in schedules.items()}
    return union_inputs(parts, column="schedule")


@query(
    "resample_series",
    """WITH seen AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS d, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE / count(*) AS m FROM orders GROUP BY 1),
    days AS (SELECT unnest(generate_series((SELECT min(d) FROM seen), (SELECT max(d) FROM seen), INTERVAL 1 DAY)) AS interval_start)
    SELECT interval_start, interval_start + INTERVAL 1 DAY AS interval_end, m AS mean_price
    FROM days LEFT JOIN seen ON d = interval_start""",
)
def resample(spark, sf):
    orders = table(spark, sf, "orders")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")  # exact in any order
    return intervals.interval_calendar(orders, "o_orderdate", "day", (total / F.count("*")).alias("mean_price"))


@query(
    "daily_load",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS interval_start, event_type, count(*) AS n_rows FROM events
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07' AND event_type IN ('click', 'view', 'purchase')
    GROUP BY 1, 2""",
)
def daily_load(spark, sf):
    days = [("2024-01-05 00:00:00", "2024-01-06 00:00:00"), ("2024-01-06 00:00:00", "2024-01-07 00:00:00")]
    counted = landed_per_type(table(spark, sf, "events"), ["click", "view", "purchase"], days)
    return counted.withColumnRenamed("_interval_start", "interval_start")
