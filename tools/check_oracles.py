"""Compare every query with its SQL: python tools/check_oracles.py <sf_dir> [query …]."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from cloakframe.plans.catalog import QUERIES
from cloakframe.plans.oracles import ORACLES
from cloakframe.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if name not in ORACLES:
        return f"rows-only {len(got[1]):8d} {took:6.1f}s"
    started = time.time()
    relation = con.execute(ORACLES[name])
    names = [d[0] for d in relation.description]
    want = rows_of(names, relation.fetchall())
    times = f"{len(got[1]):8d} {took:6.1f}s {time.time() - started:6.1f}s"
    if got == want:
        return f"equal     {times}"
    first = next(((a, b) for a, b in zip(got[1], want[1]) if a != b), None)
    return f"DIFFERENT {times} want {len(want[1])} rows, columns {got[0] == want[0]}\n   got  {first and first[0][:600]}\n   want {first and first[1][:600]}"


if __name__ == "__main__":
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("FATAL")
    sf_dir, only = sys.argv[1], sys.argv[2:]
    con = connect(sf_dir)
    for name in only or QUERIES:
        try:
            print(f"{name:24s} {compare(spark, con, name, sf_dir)}", flush=True)
        except Exception as error:  # report and go on
            print(f"{name:24s} FAILED {str(error)[:700]}", flush=True)
