"""Truncation, schedule ticks and run intervals on zone-less timestamps.

Everything is built from calendar fields (``make_timestamp_ntz``), not from ``date_trunc``: that one
goes through a zoned timestamp and depends on the session zone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = ("year", "month", "day", "hour", "minute", "second")

# The schedule names.
PRESETS = ("@hourly", "@daily", "@weekly", "@monthly", "@quarterly", "@yearly")


def ntz(value: str) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(value).cast("timestamp_ntz")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _at(day: Column) -> Column:
    return day.cast("date").cast("timestamp_ntz")


def truncate(ts: Column | str, unit: str = "day") -> Column:
    """Start of the year, month, day, hour, minute or second that holds ``ts``."""
    ts = _col(ts)
    zero, one = F.lit(0), F.lit(1)
    fields = {
        "year": (F.year(ts), one, one, zero, zero, zero),
        "month": (F.year(ts), F.month(ts), one, zero, zero, zero),
        "hour": (F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), zero, zero),
        "minute": (F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), zero),
        "second": (F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts)),
    }
    if unit == "day":
        return _at(ts)
    if unit not in fields:
        raise ValueError(f"unit must be one of {UNITS}, found {unit!r}")
    return F.make_timestamp_ntz(*fields[unit])


def _step(field: Column, n: int, first: int = 0) -> Column:
    """Largest value first, first + n, first + 2n, ... that is not above ``field``."""
    return F.floor((field - F.lit(first)) / F.lit(n)).cast("int") * F.lit(n) + F.lit(first)


def interval_tick(ts: Column | str, schedule: str) -> Column:
    """Latest tick of the schedule that is not after ``ts``.

    Rates restart with the next larger field: minutes each hour, hours each day, days each month
    (on day 1, 1 + n, ...). Weeks start on Sunday. Rates in weeks or months are refused.
    """
    ts = _col(ts)
    if schedule in PRESETS:
        return {
            "@hourly": lambda: truncate(ts, "hour"),
            "@daily": lambda: truncate(ts, "day"),
            "@weekly": lambda: _at(F.date_sub(ts.cast("date"), F.dayofweek(ts) - F.lit(1))),
            "@monthly": lambda: truncate(ts, "month"),
            "@quarterly": lambda: _at(F.make_date(F.year(ts), _step(F.month(ts), 3, 1), F.lit(1))),
            "@yearly": lambda: truncate(ts, "year"),
        }[schedule]()
    rate = re.fullmatch(r"rate\s*\(\s*([1-9]\d*)\s+(minute|hour|day)s?\s*\)", schedule)
    if rate is None:
        raise ValueError(f"no tick grid for schedule {schedule!r}")
    n, unit = int(rate.group(1)), rate.group(2)
    zero = F.lit(0)
    if unit == "minute":
        return F.make_timestamp_ntz(
            F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), _step(F.minute(ts), n), zero
        )
    if unit == "hour":
        return F.make_timestamp_ntz(
            F.year(ts), F.month(ts), F.dayofmonth(ts), _step(F.hour(ts), n), zero, zero
        )
    return _at(F.make_date(F.year(ts), F.month(ts), _step(F.dayofmonth(ts), n, 1)))


def next_tick(tick: Column | str, schedule: str) -> Column:
    """The tick after ``tick``, which is one itself: a step on, or where the next larger field starts over."""
    tick = _col(tick)
    calendar_steps = {"@hourly": "1 HOUR", "@daily": "1 DAY", "@weekly": "7 DAY", "@monthly": "1 MONTH", "@quarterly": "3 MONTH", "@yearly": "1 YEAR"}
    if schedule in calendar_steps:
        return tick + F.expr(f"INTERVAL {calendar_steps[schedule]}")
    interval_tick(tick, schedule)  # refuses what has no grid
    n, unit = re.search(r"(\d+)\s+(minute|hour|day)", schedule).groups()
    larger = {"minute": "hour", "hour": "day", "day": "month"}[unit]
    start_over = truncate(tick, larger) + F.expr(f"INTERVAL 1 {larger}")
    return F.least(tick + F.expr(f"INTERVAL {n} {unit}"), start_over)


def with_previous_interval(df: DataFrame, ts: str, schedule: str, prefix: str = "") -> DataFrame:
    """Add the complete interval that a run at ``ts`` handles: its end is the latest tick, its start
    the tick before that one."""
    start, end = f"{prefix}interval_start", f"{prefix}interval_end"
    before_end = F.col(end) - F.expr("INTERVAL '0.000001' SECOND")
    return df.withColumn(end, interval_tick(ts, schedule)).withColumn(start, interval_tick(before_end, schedule))


def within(ts: Column | str, start: Column | str, end: Column | str) -> Column:
    """Half-open interval test: start inclusive, end exclusive."""
    ts = _col(ts)
    start = ntz(start) if isinstance(start, str) else start
    end = ntz(end) if isinstance(end, str) else end
    return (ts >= start) & (ts < end)


def iso_text(ts: Column | str) -> Column:
    """``isoformat`` text: the fraction has six digits and appears only when it is not zero."""
    text = F.replace(_col(ts).cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))
    return F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)


def file_stamp(ts: Column | str) -> Column:
    """ISO text to the second with ``:`` as ``_``, for file names."""
    text = F.substring(iso_text(ts), 1, 19)
    return F.translate(text, ":", "_")


def date_argument(ts: Column | str) -> Column:
    """ISO date, or 'latest' where the date is missing."""
    return F.coalesce(_col(ts).cast("date").cast("string"), F.lit("latest"))


def iso_weekday(ts: Column | str) -> Column:
    """Monday 1 ... Sunday 7."""
    return F.weekday(_col(ts)) + F.lit(1)


def calendar(bounds: DataFrame, first: str, last: str, unit: str = "day") -> DataFrame:
    """Every [start, end) interval between two ticks, also the empty ones.

    ``bounds`` is a one-row frame with the first and the last tick; the row count of the result depends on the covered
    time only, not on the data. The days, months or years are a distributed range; units below a day are made from each
    day by the task that holds it.
    """
    spark, step = bounds.sparkSession, F.expr(f"INTERVAL 1 {unit}")
    ends = bounds.select(F.col(first).cast("timestamp_ntz").alias("a"), F.col(last).cast("timestamp_ntz").alias("b"))
    epoch = F.lit("1970-01-01").cast("date")
    parts = [x for e in ("a", "b") for x in (F.year(e), F.month(e), F.datediff(e, epoch), F.col(e).cast("string"))]
    row = ends.select(*parts).first()
    if row is None or None in tuple(row):
        empty = spark.range(0).select(F.lit(None).cast("timestamp_ntz").alias("interval_start"))
        return empty.withColumn("interval_end", F.col("interval_start") + step)
    year, month, day, text, last_year, last_month, last_day, last_text = row
    if unit in ("year", "month"):
        months = {"year": 12, "month": 1}[unit]
        begin, end = (y * 12 + (m - 1 if unit == "month" else 0) for y, m in ((year, month), (last_year, last_month)))
        first_of = F.make_date(F.floor(F.col("id") / 12).cast("int"), (F.col("id") % 12 + 1).cast("int"), F.lit(1))
        starts = spark.range(begin, end + 1, months).select(_at(first_of).alias("interval_start"))
    else:
        days = spark.range(day, last_day + 1).select(_at(F.date_add(epoch, F.col("id").cast("int"))).alias("day"))
        inside = F.sequence(F.col("day"), F.col("day") + F.expr("INTERVAL 1 DAY") - step, step)
        starts = days.select(F.explode(inside).alias("interval_start"))
    held = starts.filter(F.col("interval_start").between(F.lit(text).cast("timestamp_ntz"), F.lit(last_text).cast("timestamp_ntz")))
    return held.withColumn("interval_end", F.col("interval_start") + step)
