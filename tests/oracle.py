"""Run registered queries next to their SQL and compare rows. ``python tests/oracle.py [folder] [names]``"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def sql_rows(con, sql: str) -> tuple[list[str], list[str], Counter]:
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return ([rel.columns[i] for i in order], [str(rel.types[i]) for i in order],
            Counter(tuple(r[i] for i in order) for r in rel.fetchall()))


def spark_rows(df) -> tuple[list[str], list[str], Counter]:
    names = df.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return ([names[i] for i in order], [df.schema[i].dataType.simpleString() for i in order],
            Counter(tuple(r[i] for i in order) for r in df.collect()))


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, name: str, query, sql: str, folder: str) -> str:
    """Empty when equal, else what differs."""
    names, kinds, got = spark_rows(query(spark, folder))
    want_names, want_kinds, want = sql_rows(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if [KINDS.get(k, k) for k in kinds] != want_kinds:
        return f"types {kinds} != {want_kinds}"
    if got != want:
        return (f"rows {sum(got.values())} != {sum(want.values())}; extra {list((got - want).items())[:3]}, "
                f"missing {list((want - got).items())[:3]}")
    return "" if got else "no rows on either side"


if __name__ == "__main__":
    from conftest import session
    import __spark_entry__ as e

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, bad = session(), connect(folder), 0
    for name, query in e.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            problem = compare(spark, con, name, query, e.oracle_sql()[name], folder)
        except Exception as x:          # keep going, report all
            problem = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(problem)
        print(f"{name:26s} {time.time() - t:6.1f} s  {problem or 'ok'}", flush=True)
    print("bad:", bad)
