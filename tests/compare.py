"""Run registered queries against their SQL in DuckDB and report differences."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402


def connect(d: str):
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def _clean(x):
    return None if isinstance(x, float) and math.isnan(x) else x


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    return [columns[i] for i in order], sorted(
        (tuple(_clean(r[i]) for i in order) for r in rows), key=key
    )


def check(spark, con, name: str, d: str) -> str | None:
    """None if both engines agree, else what differs."""
    df = entry.queries()[name](spark, d)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got[1] else "no rows"
    rel = con.sql(sql)
    want = canonical(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows vs {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    types = {tuple(type(x) for x in r if x is not None) for r in got[1][:50]}
    wanted = {tuple(type(x) for x in r if x is not None) for r in want[1][:50]}
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[0]}"
    return None if types == wanted else f"types {types} vs {wanted}"


if __name__ == "__main__":
    from kinfold.session import local_session

    folder = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark, con = local_session(8), connect(folder)
    wrong = 0
    for name in names:
        t = time.time()
        try:
            problem = check(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        wrong += problem is not None
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{name:32s} {time.time() - t:6.2f}s {kind:4s} {problem or 'ok'}", flush=True)
    print(f"{len(names)} queries, {wrong} wrong")
