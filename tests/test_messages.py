import json
from datetime import datetime

from rillwork.operators.messages import Decoded
from tests.conftest import rows


def schema(stream, keys, **kinds):
    return {"type": "SCHEMA", "stream": stream, "key_properties": keys, "schema": {"type": "object", "properties": kinds}}


def record(stream, **values):
    return {"type": "RECORD", "stream": stream, "record": values}


def decoded(spark, *messages):
    texts = [(i, m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(messages)]
    return Decoded(spark.createDataFrame(texts, "at long, message string").repartition(5), "message", "at")


INTEGER, NUMBER, TEXT, MOMENT = {"type": ["null", "integer"]}, {"type": "number"}, {"type": "string"}, {"type": ["string", "null"], "format": "date-time"}


def test_schema_changes_midway(spark):
    out = decoded(
        spark,
        record("a", id=0),  # before any schema
        schema("a", ["id"], id=INTEGER, amount=INTEGER),
        record("a", id=1, amount=5), record("a", id=2, amount=5.5), record("a", id=3, amount="x", more=1),
        schema("b", [], amount=TEXT),
        schema("a", ["id"], id=INTEGER, amount=NUMBER, at=MOMENT),
        record("a", id=1, amount=5.5, at="2024-01-05T10:00:00+02:00"), record("b", amount="text"), record("b", amount="text"),
        record("c", id=1), {"type": "STATE", "value": {"a": 1}}, "no message", json.dumps([1]),
    )
    assert out.streams() == ["b", "a"] or out.streams() == ["a", "b"]
    a = out.records("a")
    assert dict(a.dtypes) == {"_order": "bigint", "_version": "bigint", "amount": "double", "at": "timestamp_ntz", "id": "bigint"}
    assert rows(a, "_order", "_version", "id", "amount", "at") == [
        (2, 1, 1, 5.0, None), (3, 1, 2, None, None), (4, 1, 3, None, None), (7, 6, 1, 5.5, datetime(2024, 1, 5, 8)),
    ]
    assert rows(out.latest("a"), "_order", "id") == [(3, 2), (4, 3), (7, 1)]
    assert rows(out.latest("b"), "_order", "amount") == [(8, "text"), (9, "text")]  # without keys all are kept
    assert rows(out.unbound(), "_order", "stream") == [(0, "a"), (10, "c")]


def test_kinds_that_do_not_go_together_are_text(spark):
    out = decoded(
        spark,
        schema("s", ["k", "j"], k=TEXT, j=INTEGER, v=INTEGER, o={"type": "object"}, b={"type": "boolean"}, d={"type": "string", "format": "date"}),
        record("s", k="a", j=1, v=7, o={"x": [1, 2]}, b=True, d="2024-02-30"),
        schema("s", ["k", "j"], k=TEXT, j=INTEGER, v={"type": "boolean"}, o={"type": ["array", "null"]}, b={"type": "boolean"}, d={"type": "string", "format": "date"}),
        record("s", k="a1", j=None, v=True, o=[1], b="maybe", d="2024-02-29"), record("s", k="a", j=1, v=False, o=None, b=False),
    )
    assert dict(out.records("s").dtypes) == {"_order": "bigint", "_version": "bigint", "k": "string", "j": "bigint", "v": "string", "o": "string", "b": "boolean", "d": "date"}
    got = [tuple(r) for r in out.records("s").select("v", "o", "b", "d").orderBy("_order").collect()]
    assert got[0] == ("7", '{"x":[1,2]}', True, None) and got[2] == ("false", None, False, None)
    assert got[1][:3] == ("true", "[1]", None) and str(got[1][3]) == "2024-02-29"
    assert rows(out.latest("s"), "_order") == [(3,), (4,)]


def test_carried_over_many_ranges(spark):
    """A stream with one schema far before most of its records, another with many."""
    messages = [schema("hot", ["i"], i=INTEGER)]
    for i in range(2000):
        messages.append(record("hot", i=i % 7))
        if i % 100 == 50:
            messages.append(schema("cold", ["i"], i=INTEGER if i % 200 == 50 else NUMBER))
        if i % 30 == 0:
            messages.append(record("cold", i=i))
    out, last, want = decoded(spark, *messages), {}, []
    for at, m in enumerate(messages):
        if m["type"] == "SCHEMA":
            last[m["stream"]] = at
        else:
            want.append((m["stream"], at, last.get(m["stream"], -1)))
    got = rows(out.bound().selectExpr("stream", "_order", "coalesce(_version, -1) AS v"))
    assert got == sorted(want)
    assert out.latest("hot").count() == 7


def test_no_messages(spark):
    out = decoded(spark)
    assert out.streams() == [] and out.unbound().count() == 0
