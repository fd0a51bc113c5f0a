import duckdb
import numpy as np

from plumbline.llm import ann, queries
from tests.llm.conftest import FOLDER


def brute(ids, x, asks, k=20):
    score = x[asks] @ x.T
    out = {}
    for row, i in zip(score, asks):
        other = [j for j in np.lexsort((ids, -row)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), row[j]) for j in other]
    return out


def found(rows):
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def recall(got, want):
    return sum(len({j for j, _ in got[q]} & {j for j, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_query_recall(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = found(queries.op10_learned_partitions(spark, FOLDER).collect())
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    exact = {(int(a), int(b)): x[i] @ x[j] for i, a in enumerate(ids) for j, b in enumerate(ids) if a % 20 == 0}
    assert all(abs(s - exact[q, j]) < 1e-12 for q, w in got.items() for j, s in w)
    assert all(w == sorted(w, key=lambda v: (-v[1], v[0])) for w in got.values())


def test_clustered_vectors_need_few_parts(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))
    index = ann.Index(x[:2000], 20)
    assert index.parts > 8 and index.probes <= index.parts // 2 and index.measured >= ann.RECALL
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(ann.search(frame, ann.F.col("vec_id") % 20 == 0, block=100, sample=2000).collect())
    assert recall(got, brute(np.arange(4000), x, np.arange(0, 4000, 20))) >= 0.9


def test_balanced():
    x = np.random.default_rng(1).normal(size=(3000, 8))
    x[:1000] *= 0.01
    label = ann.balanced_parts(x, ann.neighbours(x, np.arange(3000), 10), 16)
    assert np.bincount(label, minlength=16).max() <= np.ceil(1.1 * 3000 / 16)


def test_odd_rows(spark):
    ok = [(i, [float(i % 7), 1.0, float(i % 3)], 1) for i in range(60)]
    odd = [(100, None, 1), (120, [0.0, 0.0, 0.0], 1), (140, [1.0, None, 2.0], 1), (160, [float("nan"), 1.0, 1.0], 1),
           (180, [float("inf"), 1.0, 1.0], 1), (200, [1.0], 1), (220, [], 1), (None, [1.0, 1.0, 1.0], 1)]
    frame = spark.createDataFrame(ok + odd, "vec_id long, embedding array<float>, rank int")
    got = found(ann.search(frame, ann.F.col("vec_id") % 20 == 0, k=5).collect())
    x = np.array([v for _, v, _ in ok] + [[1.0, 1.0, 1.0]])
    want = brute(np.arange(61), x, np.array([0, 20, 40]), 5)
    assert set(got) == {0, 20, 40}
    for q in got:  # id None stands last among equals
        line = sorted([(-(x[[0, 20, 40].index(q) * 20] @ v), i is None, i or 0) for (i, *_), v in zip(ok + odd[-1:], x) if i != q])
        assert got[q] == [(None if none else i, -s) for s, none, i in line[:5]]
    assert ann.search(frame.limit(0), ann.F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_queries_and_candidates(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))]
    asks = ann.F.col("vec_id") % 20 == 0
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = found(ann.search(frame(rows), asks).collect())
    assert found(ann.search(frame(rows + [rows[0]] * 2), asks).collect())[0] == plain[0]
    nearest = plain[0][0][0]
    twice = found(ann.search(frame(rows + [rows[nearest]]), asks).collect())[0]
    assert [j for j, _ in twice] == [nearest] + [j for j, _ in plain[0]][:19]
    other = ann.search(frame(rows + [(0, rng.normal(size=8).tolist())]), asks).filter("query_id = 0").collect()
    assert sorted(r["rank"] for r in other) == sorted(2 * list(range(1, 21)))


def test_equal_vectors_in_order_of_ids(spark):
    """Every vector under two ids: blocks of any shape must give both the same score, the smaller id first."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 24))
    rows = [(i, x[i % 500].tolist()) for i in range(1000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for line in found(ann.search(frame, ann.F.col("vec_id") % 20 == 0, block=37).collect()).values():
        assert line == sorted(line, key=lambda v: (-v[1], v[0]))
        scores: dict = {}
        for j, s in line:
            scores.setdefault(j % 500, set()).add(s)
        assert all(len(s) == 1 for s in scores.values())


def test_null_ids_leave_large_ids_whole(spark):
    big = 2**62 + 1
    rows = [(big + i, [1.0, float(i % 5)]) for i in range(50)] + [(None, [1.0, 9.0])] * 3 + [(20, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.search(frame, ann.F.col("vec_id") == 20, k=10).collect())[20]
    assert [j for j, _ in got[:3]] == [None] * 3 and {j for j, _ in got[3:]} <= {big + i for i in range(50)}


def test_a_hot_id_does_not_decide_the_sample(spark):
    rng = np.random.default_rng(9)
    hot = spark.range(3000).selectExpr("7L AS vec_id", "array(1D, 0.5D, 0.25D) AS embedding")
    rest = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 3)))], hot.schema)
    rows = hot.union(rest).selectExpr("vec_id AS id", "embedding AS vector")
    taken: list = []

    class Seen(ann.Index):
        def __init__(self, x, k):
            taken.append(x)

    kept, ann.Index = ann.Index, Seen
    try:
        ann.fit(rows, 20, sample=400)
    finally:
        ann.Index = kept
    copies = (taken[0] == [1.0, 0.5, 0.25]).all(1).sum()
    assert len(taken[0]) == 400 and 120 < copies < 280
