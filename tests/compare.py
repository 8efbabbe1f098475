"""Run registered queries on Spark and their SQL on DuckDB over the same tables and compare values.

Usage: python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return value + 0.0 if value == value else None
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)) if isinstance(v, (tuple, bool)) else "", str(v)) for v in r))


def compare(spark_rows, spark_cols, sql_rows, sql_cols):
    if sorted(spark_cols) != sorted(sql_cols):
        return f"columns differ: {sorted(spark_cols)} vs {sorted(sql_cols)}"
    order = sorted(spark_cols)
    a = _sorted([tuple(_plain(r[spark_cols.index(c)]) for c in order) for r in spark_rows])
    b = _sorted([tuple(_plain(r[sql_cols.index(c)]) for c in order) for r in sql_rows])
    if len(a) != len(b):
        return f"rows differ: {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return "" if not bad else f"{len(bad)} of {len(a)} rows differ, e.g. {order}: {bad[0]}"


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def main(argv):
    import __spark_entry__ as entry
    from cashtrail.session import build_session

    folder = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        folder = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv or list(queries)
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    failed = []
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, folder)
            rows = [tuple(r) for r in df.collect()]
            spent = time.time() - t0
            if name not in oracles:
                print(f"rows  {name}: {len(rows)} rows {spent:.1f}s", flush=True)
                continue
            t1 = time.time()
            cur = con.execute(oracles[name])
            problem = compare(rows, df.columns, cur.fetchall(), [c[0] for c in cur.description])
            print(f"{'ok   ' if not problem else 'FAIL '} {name}: {len(rows)} rows {spent:.1f}s sql {time.time() - t1:.1f}s {problem[:700]}", flush=True)
        except Exception as error:
            problem = str(error)[:900]
            print(f"ERROR {name}: {problem}", flush=True)
        if name in oracles and problem:
            failed.append(name)
        elif name not in oracles and "problem" in dir() and problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
