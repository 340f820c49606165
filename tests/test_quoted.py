import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from rillwork.sources import quoted
from rillwork.sources.records import read_csv
from rillwork.suite import QUERIES
from rillwork.suite import files as file_queries
from tests.conftest import rows

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("c", T.IntegerType())])


def ends_inside(text, inside):
    """Character by character."""
    state = "quoted" if inside else "start"
    for c in text:
        if state == "quoted":
            state = "quote" if c == '"' else "quoted"
        elif state == "quote" and c == '"':
            state = "quoted"
        elif c in ",\r":
            state = "start"
        elif state == "start" and c == '"':
            state = "quoted"
        else:
            state = "plain"
    return int(state == "quoted")


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet='",a\r ', max_size=14), st.booleans())
def test_state_after_a_line(text, inside):
    assert quoted.Quotes(",").after(text, int(inside)) == ends_inside(text, inside)


def one_task(text, skip):
    lines = io.StringIO(text, newline="")
    for _ in range(skip):
        lines.readline()
    out = []
    for r in csv.reader(lines):
        if r:
            a, b, c = (r + [None] * 3)[:3]
            out.append((a or None, b or None, int(c) if c and c.strip().lstrip("-").isdigit() else None))
    return sorted(out, key=repr)


def field(rng, long):
    kind = rng.randrange(7)
    if kind == 0:
        return ""
    if kind == 1:
        return f'5" disk {rng.randrange(99)}'.replace(",", "")
    if kind == 2:
        return '"' + "\n".join('say ""x"", ' + "y" * rng.randrange(long) for _ in range(rng.randrange(1, 6))) + '"'
    if kind == 3:
        return '"line\r\nbreak\n\n"tail'
    return f"w{rng.randrange(1000)}"


def written(rng, n, long=30):
    records = [f"{field(rng, long)},{field(rng, long)},{rng.randrange(1000)}" for _ in range(n)] + ["", "only one", "x,y,1,2,3"]
    return "a,b,c\n" + rng.choice(["\n", "\r\n"]).join(records) + rng.choice(["", "\n"])


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed, few", [(1, True), (2, True), (3, False)])
def test_same_rows_as_one_task(spark, tmp_path, small_blocks, monkeypatch, seed, few):
    rng, texts = random.Random(seed), []
    if not few:
        monkeypatch.setattr(quoted, "FEW", 0)  # states come by a shuffle
    for k, (n, long) in enumerate([(200, 30), (40, 900), (1, 5), (0, 1)]):
        texts.append(written(rng, n, long))
        (tmp_path / f"f{k}.csv").write_text(texts[-1], newline="")
    got = quoted.read_quoted_csv(spark, f"file:{tmp_path}", SCHEMA)
    assert not few or got.rdd.getNumPartitions() > 20
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((x for t in texts for x in one_task(t, 1)), key=repr)


def test_lines_to_skip(spark, tmp_path, small_blocks):
    body = "".join(f'"k\n{i}",v,{i}\n' for i in range(300))
    (tmp_path / "f.csv").write_text('an "odd first line\nsecond, "line\na,b,c\n' + body)
    got = read_csv(spark, f"file:{tmp_path}", "a string, b string, c int", multi_line=True, skip_rows=2)
    assert rows(got) == sorted((f"k\n{i}", "v", i) for i in range(300))


def test_long_fields(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b,c\n"' + "x\n" * 200_000 + '",y,1\n')
    got = quoted.read_quoted_csv(spark, f"file:{tmp_path}", SCHEMA).collect()
    assert [(len(r.a), r.b, r.c) for r in got] == [(400_000, "y", 1)]


def test_many_tasks_read_one_file(spark, tmp_path):
    """60 MB in one file, in splits of 4 MB."""
    line = '"first\nsecond ""quoted"" part, and so on",' + "z" * 400
    with open(tmp_path / "f.csv", "w") as out:
        out.write("a,b,c\n")
        for i in range(120_000):
            out.write(f"{line},{i}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        got = quoted.read_quoted_csv(spark, f"file:{tmp_path}", SCHEMA)
        assert got.rdd.getNumPartitions() >= 14
        assert got.selectExpr("count(*)", "sum(c)", "count(DISTINCT a)").first()[:3] == (120_000, sum(range(120_000)), 1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_query_writes_with_many_tasks(spark, folder, monkeypatch):
    made, fresh_dir = [], file_queries.fresh_dir
    monkeypatch.setattr(file_queries, "fresh_dir", lambda *args: made.append(fresh_dir(*args)) or made[-1])
    data = [(i, [f'a "{i}"\n, b', "plain", None, '"\n"'][i % 4], "en", None, i) for i in range(400)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    found = QUERIES["scan_csv_quoted"](spark, folder)
    assert sorted(found.collect(), key=lambda r: (r[0], r[4])) == sorted([(*d[:4], n) for d in data for n in (d[4], -d[4])], key=lambda r: (r[0], r[4]))
    files = spark.read.text(made[0]).selectExpr("_metadata.file_path AS file", "value").filter("value = 'made by an \"odd program'")
    assert files.count() == files.select("file").distinct().count() > 1
