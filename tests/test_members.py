import gzip
import os

import pytest

from rillwork.sinks import members
from rillwork.suite import QUERIES
from tests.conftest import rows

TEXTS = {"a.txt": "".join(f"line {i} é\n" for i in range(3000)), "b/c.txt": "no end", "empty.txt": "", "breaks.txt": "\n\n\nx\n\n", "long.txt": "y" * 5000 + "\nz\n"}


@pytest.mark.parametrize("size", [7, 700, 1 << 20])
def test_plain_gzip_and_members(spark, folder, size):
    for name, text in TEXTS.items():
        os.makedirs(os.path.dirname(f"{folder}/in/{name}"), exist_ok=True)
        with open(f"{folder}/in/{name}", "w") as file:
            file.write(text if size > 7 else text[:3000])
    index = members.compress_in_members(spark, f"{folder}/in", f"{folder}/out", size=size)
    got = {}
    for path, at, line, value in rows(members.read_in_members(spark, f"{folder}/out"), "path", "at", "line_num", "value"):
        got.setdefault(path, []).append((at, line, value))
    for name, text in TEXTS.items():
        text = text if size > 7 else text[:3000]
        if text:
            with gzip.open(f"{folder}/out/{name}.gz", "rt") as file:
                assert file.read() == text
        lines = text.split("\n")
        assert [v for _, _, v in sorted(got.get(f"{name}.gz", []))] == (lines[:-1] if lines[-1] == "" else lines)
    per_file = {r.path: r.n for r in index.groupBy("path").count().withColumnRenamed("count", "n").collect()}
    assert per_file["a.txt.gz"] > (100 if size == 7 else 30 if size == 700 else 0)


def test_many_tasks(spark, folder):
    os.makedirs(f"{folder}/in")
    with open(f"{folder}/in/large.txt", "w") as file:
        file.writelines(f"{i} " + "w" * 90 + "\n" for i in range(300_000))
    assert members.compress_in_members(spark, f"{folder}/in", f"{folder}/out", size=1 << 20).count() >= 28
    read = members.read_in_members(spark, f"{folder}/out")
    assert read.rdd.getNumPartitions() >= 8
    assert read.selectExpr("count(*)", "sum(CAST(split(value, ' ')[0] AS BIGINT))").first()[:] == (300_000, sum(range(300_000)))


def test_sums_beyond_a_bigint(spark, folder):
    events = spark.range(4).selectExpr("id", "'view' AS event_type", "TIMESTAMP_NTZ '2024-01-01' AS ts", "1.0D AS value", "'{}' AS props")
    for first, kind in ((1, "bigint"), (4_000_000_000, "decimal(38,0)")):
        events.select((events.id + first).alias("event_id"), "event_type", "ts", "value", "props").write.parquet(f"{folder}/{first}/events.parquet")
        out = QUERIES["compress_in_members"](spark, f"{folder}/{first}")
        ids = range(first, first + 4)
        assert rows(out.selectExpr("how", "event_type", "n_rows", "ids", "CAST(squares AS STRING)")) == [(how, "view", 4, sum(ids), str(sum(i * i for i in ids))) for how in ("as plain gzip", "by members")]
        assert dict(out.dtypes) == {"how": "string", "event_type": "string", "n_rows": "bigint", "ids": "bigint", "squares": kind}
