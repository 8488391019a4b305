"""Registered queries against their SQL on the same tables: ``python tests/compare.py [folder] [names]``."""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, folder, name, build, sql):
    result = build(spark, folder)
    columns, rows = rows_of(result.columns, result.collect())
    cursor = con.execute(sql)
    expected_columns, expected = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if rows != expected:
        mine, other = set(rows) - set(expected), set(expected) - set(rows)
        return f"{len(rows)} rows, expected {len(expected)}; only here {sorted(mine)[:2]}; only there {sorted(other)[:2]}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from quaestor.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    oracles = oracle_sql()
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else list(oracles)
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "10g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, queries()[name], oracles[name])
        except Exception as error:
            problem = f"{type(error).__name__} {str(error)[:500]}"
        print("OK  " if problem is None else "DIFF", name, f"{time.time() - start:.1f}s", (problem or "")[:700], flush=True)
