"""Run registered queries on Spark and their SQL on DuckDB over the same parquet files."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[str, int, float]:
    """'ok', or what differs; row count; Spark seconds."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return ("rows only", len(got), took)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    left_cols, left = rows_of(df.columns, got)
    right_cols, right = rows_of(cols, want)
    if left_cols != right_cols:
        return (f"columns {left_cols} vs {right_cols}", len(got), took)
    if len(left) != len(right):
        return (f"rows {len(left)} vs {len(right)}", len(got), took)
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return (f"values\n  spark {a}\n  duck  {b}", len(got), took)
    return ("ok", len(got), took)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(f"/root/testdata/{sf}")
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            verdict, n, took = compare(spark, con, name, fn, oracles.get(name), f"/root/testdata/{sf}")
        except Exception as exc:  # report and go on with the other queries
            verdict, n, took = f"{type(exc).__name__}: {str(exc)[:1500]}", -1, 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:32s} {n:7d} rows {took:6.2f}s  {verdict}", flush=True)
    print("bad:", bad)
