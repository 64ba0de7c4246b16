"""Run registered queries and their SQL twins side by side: ``python tests/oracle_check.py [names]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only: {len(got[1])}"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} <> {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"ROWS {len(got[1])} <> {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"VALUES\n  spark  {a}\n  duckdb {b}"
    return f"ok {len(got[1])}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE", "8"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, names = connect(sf_dir), e.oracle_sql(), sys.argv[1:]
    for name, fn in e.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception:
            verdict = "ERROR " + traceback.format_exc(limit=-3)[-1500:]
        print(f"{name:28s} {time.time() - start:6.1f}s  {verdict}", flush=True)
