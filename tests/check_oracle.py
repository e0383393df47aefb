"""Run registered queries beside their oracle statements: python tests/check_oracle.py [pattern] [sf]."""

from __future__ import annotations

import os
import re
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
import __spark_entry__ as entry  # noqa: E402
from ballast.session import local_session  # noqa: E402
from ballast.testbed import BASE_TABLES  # noqa: E402

ROOT = "/root/testdata"


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT:
            return None
        if isinstance(v, float):
            return None if v != v else repr(v)
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return None if v != v else repr(v)
        return str(v)

    cols = sorted(frame.columns)
    return sorted((tuple(cell(v) for v in row) for row in frame[cols].itertuples(index=False)), key=str)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute("set memory_limit='8GB'")
    con.execute("set temp_directory=''")
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int, float, float]:
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spark_s = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ("rows-only" if rows else "EMPTY", len(rows), spark_s, 0.0)
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    duck_s = time.time() - start

    def norm(cols, data):
        order = sorted(range(len(cols)), key=lambda i: cols[i])

        def cell(v):
            if isinstance(v, float):
                return None if v != v else v
            if isinstance(v, (list, tuple)):
                return str([cell(x) for x in v])
            return v

        return sorted((tuple(cell(r[i]) for i in order) for r in data), key=lambda t: [str(x) for x in t])

    a, b = norm(df.columns, rows), norm(names, expected)
    if sorted(df.columns) != sorted(names):
        return (f"COLUMNS {sorted(df.columns)} != {sorted(names)}", len(rows), spark_s, duck_s)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2]
        missing = [x for x in b if x not in set(a)][:2]
        return (f"ROWS {len(a)} != {len(b)} extra={extra} missing={missing}", len(rows), spark_s, duck_s)
    for x, y in zip(a, b):
        if x != y:
            return (f"VALUES {x} != {y}", len(rows), spark_s, duck_s)
    types = {}
    for field in df.schema.fields:
        types[field.name] = field.dataType.simpleString()
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    odd = [
        (c, types[c], duck_types[c]) for c in types
        if {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}.get(types[c], "?") != duck_types[c]
    ]
    if not rows:
        return ("EMPTY", 0, spark_s, duck_s)
    return ("ok" if not odd else f"ok TYPES {odd}", len(rows), spark_s, duck_s)


def main() -> None:
    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf_dir = f"{ROOT}/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}"
    spark, con = local_session(8), duck(sf_dir)
    bad = 0
    for name in entry.queries():
        if not re.search(pattern, name):
            continue
        try:
            status, n, spark_s, duck_s = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            status, n, spark_s, duck_s = f"ERROR {str(error)[:1500]}", -1, 0, 0
        bad += not status.startswith(("ok", "rows-only"))
        print(f"{name:40s} {n:8d} {spark_s:6.2f}s {duck_s:6.2f}s {status}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
