"""Compare registered queries with their SQL statements: names, row counts, values without regard to order."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from gistmill.registry import all_oracles, all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf: str) -> str | None:
    """None when equal, else what differs."""
    got_df = all_queries()[name](spark, sf)
    got = table(got_df.columns, [tuple(r) for r in got_df.collect()])
    cur = con.execute(all_oracles()[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if not want[1]:
        return "no rows"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(bad)} of {len(want[1])} rows differ, first: {str(bad[0])[:600]}" if bad else None


if __name__ == "__main__":
    from gistmill.session import build_session

    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    con = connect(sf)
    names = sys.argv[2:] or list(all_queries())
    fails = 0
    for name in names:
        start = time.time()
        try:
            if name not in all_oracles():
                res = None
                n = all_queries()[name](spark, sf).count()
                note = f"rows only: {n}"
            else:
                res, note = compare(spark, con, name, sf), "ok"
        except Exception as e:
            res = f"{type(e).__name__}: {str(e)[:1500]}"
        fails += res is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {'FAIL ' + res if res else note}", flush=True)
    print("failures:", fails)
