"""Run registered queries next to their oracle SQL: python tests/check_oracle.py SF [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SMALLEST = "/root/testdata/sf0.001"


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def key(row):
    return tuple((v is None, str(type(v)) if v is None else "", str(v)) for v in row)


def compare(df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, otherwise a description of the difference."""
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=key)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, e.g. {cols}: {bad[0]}"
    return None


def main() -> None:
    import __spark_entry__ as e
    from tallyweave.session import build_session
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = e.oracle_sql()
    failed = 0
    for name, q in e.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            df = q(spark, sf_dir)
            if name in oracle:
                problem = compare(df, con, oracle[name])
                n = df.count() if len(sys.argv) > 2 else ""
            else:
                problem, n = None, f"{df.count()} rows, no oracle"
        except Exception as ex:  # noqa: BLE001
            problem, n = f"{type(ex).__name__}: {str(ex)[:1500]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {n} {problem or ''}",
              flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
