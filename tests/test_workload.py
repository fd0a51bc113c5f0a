"""Every query against its SQL on the smallest data folder, and the shape of its plan."""

import os
from collections import Counter

import pytest

from plumbline.workload.registry import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def norm(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    df = queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name not in oracle_sql():
        assert sum(got.values()) > 0
        return
    result = db.sql(oracle_sql()[name])
    order = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
    assert columns == sorted(result.columns)
    assert got == Counter(tuple(norm(r[i]) for i in order) for r in result.fetchall())


def test_every_query_is_named_plainly_and_has_sql():
    known = queries()
    assert set(oracle_sql()) <= set(known)
    assert len(known) - len(oracle_sql()) <= 2


def test_the_logged_suite_runs_every_saved_check(spark, db, monkeypatch):
    """All 29 checks for the second batch, none left out, with the outcomes that their SQL has for it."""
    from plumbline.workload import layers, suite

    first, second = suite.BATCHES[:2]
    monkeypatch.setattr(suite, "B1", second)
    monkeypatch.setattr(suite, "DAYS", layers.DAYS)
    monkeypatch.setattr(suite, "_marks_sql", lambda last: layers._marks_sql(first, last))
    text = suite.queries()["suite_outcomes"][1]
    # One claim has a later version, so what the window holds of it is not its latest; the first batch's window has no such claim.
    windowed = "FROM trn_claim WHERE RECORD_EFFECTIVE_TS >="
    assert text.count(windowed) == 1
    told = db.sql(text.replace(windowed, "FROM (FROM trn_claim QUALIFY row_number() OVER (PARTITION BY CLAIM_ID "
                               "ORDER BY RECORD_EFFECTIVE_TS DESC) = 1) WHERE RECORD_EFFECTIVE_TS >="))
    want = {r["test_id"]: (r["status"], r["failed_record_count"]) for r in (dict(zip(told.columns, x)) for x in told.fetchall())}
    found = queries()["suite_log"](spark, FOLDER).collect()
    assert len(found) == len(want) == 29 and all(r.all_logged for r in found)
    assert {r.test_case_id: (r.status, r.failed_record_count) for r in found} == want
