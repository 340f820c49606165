import re
from datetime import datetime, timedelta
from difflib import SequenceMatcher
from urllib.parse import quote, unquote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillwork.functions import intervals, paths, text, urls
from rillwork.functions.json_values import items_of, pick_each, pick_each_fields, pick_list, pick_where, record_text, search
from rillwork.plans.matching import fuzzy_match
from tests.conftest import rows


def per_value(spark, values, schema, **columns):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {schema}").select(
        "i", *[c.alias(n) for n, c in columns.items()]
    )
    return [tuple(r)[1:] for r in df.orderBy("i").collect()]


TEXTS = st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\x00")), min_size=30, max_size=60)


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_quote_and_unquote_like_python(spark, values):
    got = per_value(spark, values, "string", q=urls.quote("v"), u=urls.unquote(urls.quote("v")))
    assert got == [(quote(v), v) for v in values]


def test_unquote_keeps_plus_and_bad_escapes(spark):
    values = ["a+b%20c", "100%", "%zz%41", "%4", "%C3%A9t%C3%A9", "50%%25"]
    assert per_value(spark, values, "string", u=urls.unquote("v")) == [(unquote(v),) for v in values]


def test_white_space_is_python_white_space(spark):
    values = [f"a{chr(c)}b" for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    got = per_value(spark, values, "string", n=text.word_count("v"))
    assert got == [(len(re.split(r"\s+", v)),) for v in values]


def test_word_count_golden(spark):
    values = ["To be, or not to be, that is the question", "", " a ", "a\n\nb"]
    assert per_value(spark, values, "string", n=text.word_count("v")) == [(10,), (1,), (3,), (2,)]


NAMES = ["J. K. Rowling", "J K Rowling", "j. k. rowling", "George R. R. Martin", "George Martin", "", "x", "James Clavell"]


def by_hand(a, b):
    a, b = a.lower(), b.lower()
    if a == b:
        return 100
    return int(round(100 * SequenceMatcher(None, a, b).ratio())) if a and b else 0


def test_similarity_like_python(spark):
    pairs = [(a, b) for a in NAMES for b in NAMES] + [("x", None), (None, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = rows(df.select("i", text.similarity("a", "b"), text.is_similar("a", "b", 90), text.is_similar("a", "b", 0)))
    for i, (a, b) in enumerate(pairs):
        want = by_hand(a, b) if a is not None and b is not None else 0
        assert got[i] == (i, want, want > 90, want > 0), (a, b)


def brute_tick(at, schedule):
    """Walk back minute by minute until the schedule fires."""
    fires = {
        "@hourly": lambda t: t.minute == 0,
        "@daily": lambda t: t.minute == t.hour == 0,
        "@weekly": lambda t: t.minute == t.hour == 0 and t.isoweekday() == 7,
        "@monthly": lambda t: t.minute == t.hour == 0 and t.day == 1,
        "@quarterly": lambda t: t.minute == t.hour == 0 and t.day == 1 and t.month in (1, 4, 7, 10),
        "rate(45 minutes)": lambda t: t.minute in (0, 45),
        "rate(7 hours)": lambda t: t.minute == 0 and t.hour in (0, 7, 14, 21),
        "rate(10 days)": lambda t: t.minute == t.hour == 0 and t.day in (1, 11, 21, 31),
    }[schedule]
    t = at.replace(second=0, microsecond=0)
    while not fires(t):
        t -= timedelta(minutes=1)
    return t


MOMENTS = [
    datetime(2024, 3, 1),
    datetime(2024, 2, 29, 23, 59, 59, 999999),
    datetime(2021, 2, 28, 0, 44, 59),
    datetime(2021, 2, 28, 0, 45),
    datetime(2024, 3, 31, 2, 30, 0, 1),
    datetime(2024, 10, 27, 21, 0),
    datetime(2023, 12, 31, 12, 0),
]


@pytest.mark.parametrize("schedule", ["@hourly", "@daily", "@weekly", "@monthly", "@quarterly", "rate(45 minutes)", "rate(7 hours)", "rate(10 days)"])
@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_ticks_by_brute_force(spark, schedule, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(MOMENTS)], "i int, at timestamp_ntz")
        out = intervals.with_previous_interval(df, "at", schedule).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for row, at in zip(out, MOMENTS):
        end = brute_tick(at, schedule)
        assert (row.interval_start, row.interval_end) == (brute_tick(end - timedelta(microseconds=1), schedule), end)


@pytest.mark.parametrize("schedule", ["rate(2 weeks)", "rate(1 month)", "rate(5 seconds)", "rate(0 days)", "0 * * * *"])
def test_schedules_without_grid_are_refused(schedule):
    with pytest.raises(ValueError):
        intervals.interval_tick(F.col("at"), schedule)


def test_iso_text_like_isoformat(spark):
    values = MOMENTS + [datetime(2024, 1, 1, 0, 0, 0, 500000), datetime(2024, 1, 1, 0, 0, 0, 120)]
    assert per_value(spark, values, "timestamp_ntz", s=intervals.iso_text("v")) == [(v.isoformat(),) for v in values]


def test_truncate(spark):
    at = datetime(2024, 3, 31, 2, 30, 15, 123456)
    got = per_value(spark, [at], "timestamp_ntz", **{u: intervals.truncate("v", u) for u in intervals.UNITS})[0]
    assert got == (
        datetime(2024, 1, 1), datetime(2024, 3, 1), datetime(2024, 3, 31), datetime(2024, 3, 31, 2),
        datetime(2024, 3, 31, 2, 30), datetime(2024, 3, 31, 2, 30, 15),
    )
    with pytest.raises(ValueError):
        intervals.truncate("v", "fortnight")


def test_paths(spark):
    values = ["/a/foo.tar.gz", "b/.hidden", "b/.hidden.txt", "plain", "/dir/sub/", "x."]
    got = per_value(
        spark, values, "string",
        n=paths.name("v"), st=paths.stem(paths.name("v")), su=paths.suffix(paths.name("v")), all=paths.suffixes(paths.name("v")),
    )
    assert got == [
        ("foo.tar.gz", "foo", ".gz", [".tar", ".gz"]),
        (".hidden", ".hidden", "", []),
        (".hidden.txt", ".hidden.txt", ".txt", [".hidden", ".txt"]),
        ("plain", "plain", "", []),
        ("sub", "sub", "", []),
        ("x.", "x", ".", ["."]),
    ]


def test_table_from_path(spark):
    values = ["data_clients_2021-02-18T03_00_00.csv", "/in/data_a_b_2021-02-18T03_00_00.csv", "clients.csv"]
    assert per_value(spark, values, "string", t=paths.table_from_path("v")) == [("clients",), ("a_b",), (None,)]


def test_clean_names(spark):
    got = per_value(spark, ["a b/c-é"], "string", f=paths.clean_filename("v"), i=paths.clean_identifier("v"))
    assert got == [("a_b_c-_", "a_b_c_é")]


def test_path_formats(spark):
    df = spark.createDataFrame([("file:/base/dir/a.txt",)], "p string")
    forms = [paths.as_format("p", base, how) for base in ("/base/dir/", "file:/base/dir") for how in ("relative", "absolute", "url")]
    assert tuple(df.select(*forms).first()) == ("a.txt", "/base/dir/a.txt", "file:/base/dir/a.txt") * 2


def test_record_text_keeps_nulls_and_types(spark):
    df = spark.sql(
        "SELECT CAST(1.50 AS DECIMAL(5,2)) d, X'00ff' b, CAST(NULL AS STRING) n, DATE '2024-01-02' day, "
        "TIMESTAMP_NTZ '2024-01-02 03:04:05.5' t, array(X'01') bs, named_struct('x', CAST(2 AS DECIMAL(3,1))) s"
    )
    assert df.select(record_text(df)).first()[0] == (
        '{"d":1.5,"b":"00ff","n":null,"day":"2024-01-02","t":"2024-01-02T03:04:05.500000","bs":["01"],"s":{"x":2.0}}'
    )


def test_search_results(spark):
    texts = ['{"a": {"b": [1, 2]}}', '{"a": {"b": []}}', '{"a": {"b": 7}}', '{"a": {}}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    assert rows(search(df, "j", "$.a.b", "int").na.fill(-1, ["item"]), "i", "item") == [(0, 1), (0, 2), (2, 7), (3, -1)]
    whole = search(df, "j", "$.a.b[1]", "int", explode_lists=False).na.fill(-1, ["item"])
    assert rows(whole, "i", "item") == [(0, 2), (1, -1), (2, -1), (3, -1)]
    nested = spark.createDataFrame([('{"a": [{"x": 1}, {"y": 2}, {"x": 3}]}',)], "j string")
    assert nested.select(pick_each(F.parse_json("j"), "$.a", "$.x", "int")).first()[0] == [1, 3]
    v = F.parse_json("j")
    assert nested.select(pick_list(v, ["$.a[0].x", "$.b", "$.a[2].x"], "int")).first()[0] == [1, None, 3]
    assert nested.select(pick_each_fields(v, "$.a", {"p": ("$.x", "int"), "q": ("$.y", "int")})).first()[0] == [(1, None), (None, 2), (3, None)]
    assert nested.select(pick_each_fields(v, "$.b", {"p": ("$.x", "int")})).first()[0] is None
    assert nested.select(F.to_json(pick_where(v, "$.a", "$.x", "int", lambda x: x > 1))).first()[0] == '[{"x":3}]'
    assert nested.select(F.size(items_of(F.parse_json("j"), "$.a"))).first()[0] == 3


@pytest.mark.parametrize("unit", ["second", "minute", "hour", "day", "month", "year"])
def test_calendar_units(spark, unit):
    first, last = {"second": ("2024-02-28 23:59:50", "2024-02-29 00:00:10"), "minute": ("2024-02-28 23:55:00", "2024-02-29 00:03:00")}.get(
        unit, ("2023-11-01 00:00:00" if unit != "year" else "2023-01-01 00:00:00", "2024-03-01 00:00:00" if unit != "year" else "2026-01-01 00:00:00")
    )
    bounds = spark.range(1).select(*[F.lit(x).cast("timestamp_ntz").alias(n) for n, x in (("a", first), ("b", last))])
    got = [r.interval_start for r in intervals.calendar(bounds, "a", "b", unit).orderBy("interval_start").collect()]
    want = spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ '{first}', TIMESTAMP_NTZ '{last}', INTERVAL 1 {unit})) AS t").collect()
    assert got == [r.t for r in want] and got[0] == datetime.fromisoformat(first)
    assert intervals.calendar(bounds.limit(0), "a", "b", unit).count() == 0


@pytest.mark.parametrize("schedule", ["rate(45 minutes)", "rate(90 minutes)", "rate(5 hours)", "rate(10 days)", "@hourly", "@weekly", "@monthly", "@quarterly", "@yearly"])
def test_next_tick_is_the_first_one_after(spark, schedule):
    times = spark.range(2000).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id") * 317)).alias("ts"))
    ticks = times.select(intervals.interval_tick("ts", schedule).alias("tick")).distinct()
    after = ticks.withColumn("after", intervals.next_tick("tick", schedule))
    just = F.expr("INTERVAL '0.000001' SECOND")
    checked = after.select((intervals.interval_tick("after", schedule) == F.col("after")) & (intervals.interval_tick(F.col("after") - just, schedule) == F.col("tick")) & (F.col("after") > F.col("tick")))
    assert {r[0] for r in checked.collect()} == {True}


def test_identifier_without_a_backslash(spark):
    assert spark.range(1).select(paths.clean_identifier(F.lit("a\\b c"))).first()[0] == "a_b_c"


def test_route_and_score_take_the_names_in_one_order(spark):
    pairs = [("ecru lace", "lace ecru"), ("abcdabxx", "bxxabcda"), ("private", "priavte"), ("tidal", "tidall"), ("same", "SAME"), ("aab", "aba")]
    df = spark.createDataFrame(pairs, "requested string, returned string").withColumn("score", text.similarity("returned", "requested"))
    for r in fuzzy_match(df, "requested", "returned", 80).collect():
        want = int(round(SequenceMatcher(None, r.returned.lower(), r.requested.lower()).ratio() * 100))
        assert abs(r.score - want) <= 1 and (r.route == "valid") == (r.score > 80)
