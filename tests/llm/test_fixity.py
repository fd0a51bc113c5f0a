import random
from collections import Counter

import duckdb
import pytest

from plumbline.llm import fixity, queries
from tests.llm.conftest import FOLDER

DDL = "file string, offset long, length long, body binary, hash string, copies int"


def brute(a, b):
    """Offsets at which the multisets of records differ."""
    def by_place(rows):
        out: dict = {}
        for f, o, n, body, *_ in rows:
            out.setdefault((f, o), Counter())[(n, body)] += 1
        return out

    one, two = by_place(a), by_place(b)
    return {k: "missing" if k not in two else "additional" if k not in one else "changed"
            for k in one.keys() | two.keys() if one.get(k) != two.get(k)}


def test_random_damage_in_deep_trees(spark):
    rng = random.Random(6)
    good, at = [], 0
    for i in range(600):
        body = rng.randbytes(rng.randrange(0, 60))
        good.append((f"f{i // 200}", at % 90000, len(body), body, "x", 1))
        at += len(body)
    bad = [r if rng.random() > 0.02 else (*r[:3], rng.randbytes(5), *r[4:]) for r in good if rng.random() > 0.02]
    bad += [("f9", 5, 1, b"z", "x", 1), ("f0", 10**6, 1, b"z", "x", 1)] + bad[:2]
    found = fixity.audit(spark.createDataFrame(good, DDL), spark.createDataFrame(bad, DDL), 64, 3, 4).collect()
    assert {(r.file, r.offset): r.problem for r in found} == brute(good, bad) and len(found) == len(brute(good, bad))


def test_equal_replicas_and_odd_rows(spark):
    rows = [(None, None, None, None, "x", 1), ("a", None, 0, b"", "x", 1), ("a", 0, 3, None, None, None),
            ("a", 0, 3, None, None, None), ("b", 7, 0, b"", "x", 1), ("b", 7, 50000, b"y" * 50000, "x", 1)]
    one = spark.createDataFrame(rows, DDL)
    assert fixity.audit(one, one.repartition(3)).count() == 0
    assert fixity.audit(one.limit(0), one.limit(0)).count() == 0
    assert {(r.file, r.offset): r.problem for r in fixity.audit(one, one.limit(0)).collect()} == brute(rows, [])
    other = [rows[0], ("a", None, 0, None, "x", 1), *rows[2:3], *rows[4:]]
    found = fixity.audit(one, spark.createDataFrame(other, DDL)).collect()
    assert {(r.file, r.offset): r.problem for r in found} == brute(rows, other)


def test_only_differing_branches_are_read(spark):
    rows = [("f", i * 10, 10, bytes([i % 251]) * 10, "x", 1) for i in range(2000)]
    damaged = rows[:700] + [("f", 7000, 10, b"?" * 10, "x", 1)] + rows[701:]
    a, b = (fixity.leaves(spark.createDataFrame(r, DDL)) for r in (rows, damaged))
    up, down = fixity.tree(a, 100, 8, 4), fixity.tree(b, 100, 8, 4)
    for x, y in zip(up, down):
        assert fixity._differing(x, y, ["file", "part"]).count() == 1
    assert [x.count() for x in up] == [200, 25, 4, 1]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = db.sql(queries.SQL[name])
    order = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
    assert columns == sorted(result.columns)
    got = Counter(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got and got == Counter(tuple(str(r[i]) for i in order) for r in result.fetchall())
