"""Compare registered queries with their SQL in DuckDB. As a script: python tests/oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def local_session() -> SparkSession:
    from ledgerlens.session import build_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "check",
        f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, decimal.Decimal):
        raise TypeError("decimal in a result")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=repr)


def compare(spark: SparkSession, con, sf_dir: str, build, sql: str | None) -> tuple[str, int]:
    df = build(spark, sf_dir)
    names, ours = rows_of(df.columns, df.collect())
    if sql is None:
        return "rows only", len(ours)
    cursor = con.execute(sql)
    their_names, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != their_names:
        return f"columns differ: {sorted(set(names) ^ set(their_names))}", len(ours)
    if len(ours) != len(theirs):
        return f"rows differ: {len(ours)} and {len(theirs)}", len(ours)
    for mine, other in zip(ours, theirs):
        for n, a, b in zip(names, mine, other):
            if a != b or type(a) is not type(b):
                bad = sum(x != y for x, y in zip(ours, theirs))
                return f"values differ in {bad} rows, first at {n}: {a!r} and {b!r}", len(ours)
    return "ok", len(ours)


def main() -> None:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(), database(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in queries:
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        started = time.time()
        try:
            verdict, n = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as error:  # report and go on with the next query
            verdict, n = f"error: {str(error)[:600]}", -1
        if verdict not in ("ok", "rows only"):
            failed.append(name)
        print(f"{name:34} {n:8} rows {time.time() - started:6.2f}s  {verdict}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
