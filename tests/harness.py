"""Run registered queries beside their SQL text in DuckDB and compare whole results.

    python tests/harness.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from lodework.session import TABLES, build_session  # noqa: E402

DATA = "/root/testdata"
TIMES: dict[str, float] = {}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """One comparable form for both engines; kinds stay apart (1 is not 1.0 is not True)."""
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("float", "nan") if math.isnan(value) else ("float", value + 0.0)
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value.normalize()))
    if isinstance(value, dt.datetime):
        return ("datetime", value.replace(tzinfo=None).isoformat())
    if isinstance(value, dt.date):
        return ("date", value.isoformat())
    if isinstance(value, (bytes, bytearray)):
        return ("bytes", bytes(value).hex())
    if isinstance(value, (list, tuple)):
        return ("list", tuple(plain(v) for v in value))
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(name, df, con, sql):
    """None when equal, else a short account of the first difference."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    TIMES["spark"] = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(got)
    if got == want:
        return None, len(got)
    diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
    return f"rows {len(got)} vs {len(want)}; first differences {diff}"[:1500], len(got)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--plain", action="store_true", help="session with Spark's own defaults")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as contract

    if args.plain:
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false").getOrCreate()
    else:
        spark = build_session("harness", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                              "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/sf{args.sf}"
    con = connect(sf_dir)
    queries, oracles = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem, n = compare(name, df, con, oracles[name])
            else:
                problem, n = None, df.count()
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {error}"[:1800], -1
        spent = TIMES.pop("spark", time.time()) - start
        bad += problem is not None
        kind = "" if name in oracles else " (rows only)"
        print(f"{'ok ' if problem is None else 'BAD'} {name:26s} {n:7d} rows {spent:6.2f}s spark {time.time() - start:6.2f}s all{kind}"
              + (f"\n    {problem}" if problem else ""), flush=True)
    print(f"{bad} bad", flush=True)


if __name__ == "__main__":
    main()
