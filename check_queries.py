"""Run every query next to its SQL on one data folder and compare the results."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from plumbline.session import local_session
from plumbline.workload.registry import oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def main(folder: str, names: list[str]) -> int:
    spark = local_session("check", 8)
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    expected, bad = oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = run(spark, folder)
            cols = sorted(df.columns)
            got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
        except Exception as exc:
            print(f"ERROR {name}: {str(exc)[:600]}")
            bad += 1
            continue
        took = time.time() - began
        if name not in expected:
            print(f"rows  {name}: {sum(got.values())} ({took:.1f}s)")
            continue
        began = time.time()
        res = db.sql(expected[name])
        names_db = res.columns
        order = sorted(range(len(names_db)), key=lambda i: names_db[i])
        want = Counter(tuple(norm(r[i]) for i in order) for r in res.fetchall())
        if cols != sorted(names_db):
            print(f"COLS  {name}: {cols} vs {sorted(names_db)}")
            bad += 1
        elif got != want:
            bad += 1
            print(f"DIFF  {name}: {sum(got.values())} vs {sum(want.values())} rows; "
                  f"only spark {list((got - want).items())[:3]} "
                  f"only sql {list((want - got).items())[:3]}")
        else:
            print(f"ok    {name}: {sum(got.values())} rows ({took:.1f}s, "
                  f"sql {time.time() - began:.1f}s)")
    print(f"{bad} problem(s)")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
