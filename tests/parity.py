"""Run registered queries beside their oracle SQL: python tests/parity.py [sf folder] [name prefix ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def duck(folder):
    import duckdb

    from cohortlens.plans.registry import TABLES

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if value is None or isinstance(value, (bool, int, str)):
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=lambda r: [(v is None, str(v)) for v in r])


def compare(spark, con, name, build, sql, folder):
    """None if the two sides agree, else what differs."""
    df = build(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None, len(got)
    relation = con.execute(sql)
    columns = [d[0] for d in relation.description]
    want = relation.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    diff = [(x, y) for x, y in zip(a, b) if x != y or [type(v) for v in x] != [type(v) for v in y]]
    return (f"{len(diff)} rows differ, e.g. {sorted(columns)} {diff[:2]}" if diff else None), len(got)


if __name__ == "__main__":
    from cohortlens import plans

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = tuple(sys.argv[2:])
    queries, oracles = plans.load()
    spark, con, bad = session(), duck(folder), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name, build in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            problem, count = compare(spark, con, name, build, oracles.get(name), folder)
        except Exception as error:  # report and go on with the next query
            text = str(error)
            problem, count = (text[:700] if "-v" not in sys.argv else traceback.format_exc()), -1
        bad += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} {count} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failed:", bad)
