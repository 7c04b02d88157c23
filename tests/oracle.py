"""Compare a Spark result with DuckDB's answer to the reference SQL.

Run as a script: ``python tests/oracle.py [sf dir] [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _cell(value) -> str:
    if value is None or value is pd.NaT:
        return "NULL"
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, bool):
        return repr(value)
    if hasattr(value, "item"):
        return _cell(value.item())
    if isinstance(value, pd.Timestamp):
        return str(value.date()) if value == value.normalize() else str(value)
    if isinstance(value, int):
        return str(value)
    return str(value)


def canonical(columns, rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal, else a short description of the difference."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = canonical(names, cursor.fetchall())
    got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    compare.rows = len(got[1])
    if want[0] != got[0]:
        return f"columns: spark {got[0]} duckdb {want[0]}"
    if len(want[1]) != len(got[1]):
        return f"rows: spark {len(got[1])} duckdb {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(got[0], a, b) if x != y]
            return f"spark {a}\nduckdb {b}\ndiffering {diff[:4]}"
    return None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as app

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    chosen = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf), []
    oracles = app.oracle_sql()
    for name, fn in app.queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                rows = compare.rows
            else:
                problem, rows = None, len(df.collect())
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        kind = "sql" if name in oracles else "rows-only"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] rows={rows} {time.time()-start:.1f}s", flush=True)
        if problem:
            failed.append(name)
            print("     " + problem.replace("\n", "\n     "), flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
