"""Run registered queries beside their SQL and compare: ``python tools/check.py SF_DIR [key ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(c.lower() for c in columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def compare(spark, con, key: str, sf_dir: str, queries, oracles) -> tuple[str, float]:
    begun = time.time()
    df = queries[key](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - begun
    if key not in oracles:
        return f"rows only: {len(rows)}", took
    result = con.execute(oracles[key])
    names = [d[0] for d in result.description]
    got_names, got = bag(df.columns, rows)
    want_names, want = bag(names, result.fetchall())
    if got_names != want_names:
        return f"COLUMNS {got_names} / {want_names}", took
    kinds = {d[0]: str(d[1]) for d in result.description}
    odd = {f.name: (f.dataType.simpleString(), kinds[f.name]) for f in df.schema.fields if TYPES.get(f.dataType.simpleString()) != kinds[f.name]}
    if odd:
        return f"TYPES {odd}", took
    if got != want:
        extra, missing = got - want, want - got
        return f"VALUES spark {sum(got.values())} sql {sum(want.values())} extra {list(extra)[:2]} missing {list(missing)[:2]}", took
    return f"ok {len(rows)}", took


def main() -> int:
    from rillwork.session import build_session
    from rillwork.suite import ORACLES, QUERIES

    sf_dir, keys = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for key in keys:
        try:
            verdict, took = compare(spark, con, key, sf_dir, QUERIES, ORACLES)
        except Exception as error:  # noqa: BLE001
            verdict, took = f"ERROR {type(error).__name__} {str(error)[: int(os.environ.get('CHECK_CHARS', '600'))]}", 0.0
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{took:7.2f}  {key:30s} {verdict}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
