"""Compare registered queries with their oracle SQL: ``python -m tests.oracle [name-prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def duck(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, bool):
        return str(v)
    return repr(float(v)) if isinstance(v, int) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, d: str, name: str) -> str:
    df = entry.queries()[name](spark, d)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    text = entry.oracle_sql().get(name)
    if text is None:
        return f"rows {len(got)}"
    cur = con.execute(text)
    columns = [c[0] for c in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"MISMATCH columns {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        a, b = set(got), set(want)
        return f"MISMATCH {len(got)} vs {len(want)}; only spark {list(a - b)[:3]}; only sql {list(b - a)[:3]}"
    return f"ok {len(got)}"


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main(prefixes: list[str]) -> int:
    d = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con, bad = session(), duck(d), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in entry.queries():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            result = compare(spark, con, d, name)
        except Exception as e:  # noqa: BLE001
            result = "ERROR " + (traceback.format_exc() if os.environ.get("TRACE") else str(e)[:600])
        bad += result.startswith(("MISMATCH", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.1f}s  {result}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
