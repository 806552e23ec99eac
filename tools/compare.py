"""Run registered queries against their SQL in DuckDB and report differences and times.

    python tools/compare.py [--sf DIR] [--only name,name] [--cores N]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from gridpulse.catalog import all_queries
from gridpulse.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    """One printable form for a value of either engine."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    return str(value)


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(connection, columns, got, sql):
    """What differs between collected rows and the answer of the SQL; None if nothing does."""
    if sql is None:
        return None if got else "no rows"
    answer = connection.execute(sql)
    names = [d[0] for d in answer.description]
    want = answer.fetchall()
    if sorted(names) != sorted(columns):
        return f"columns {sorted(columns)} but {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows but {len(want)}"
    for mine, theirs in zip(rows_of(got, columns), rows_of(want, names)):
        if mine != theirs:
            return f"{mine} but {theirs}"
    return None


def compare(spark, connection, query, sf_dir):
    """(seconds, rows, problem) of one query."""
    begin = time.time()
    frame = query.run(spark, sf_dir)
    got = frame.collect()
    seconds = time.time() - begin
    return seconds, len(got), difference(connection, frame.columns, got, query.sql)


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--cores", default="8")
    args = parser.parse_args()
    spark = local_session(args.cores)
    connection = connect(args.sf)
    wanted = set(filter(None, args.only.split(",")))
    failed = 0
    for name, query in all_queries().items():
        if wanted and name not in wanted:
            continue
        try:
            seconds, n, problem = compare(spark, connection, query, args.sf)
        except Exception as e:
            seconds, n, problem = 0.0, 0, f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:24s} {n:7d} rows {seconds:6.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
