import numpy as np

from plumbline.llm import mixing, queries
from tests.llm import brute
from tests.llm.conftest import FOLDER


def check(rows, docs):
    sizes = {d[0]: len(brute.words(d[1])) for d in docs}
    totals: dict = {}
    for d in docs:
        totals[d[3]] = totals.get(d[3], 0) + sizes[d[0]]
    source = {d[0]: d[3] for d in docs}
    want = mixing.targets(totals)
    taken: dict = {}
    for r in rows:
        assert r["size"] == sizes[r.doc_id] and r.source_size == totals[source[r.doc_id]]
        assert 0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert sorted(r.doc_id for r in rows) == sorted(sizes)
    return taken, want, totals


def test_query_comes_near_its_targets(spark, documents):
    rows = queries.op6_mixing(spark, FOLDER).collect()
    taken, want, totals = check(rows, documents)
    for s in want:
        largest = max(len(brute.words(d[1])) for d in documents if d[3] == s)  # ten documents to a source
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], largest / 2) + 1
    again = queries.op6_mixing(spark, FOLDER).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_nearest_sums():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes = rng.integers(1, 2000, 300)
        room = int(rng.integers(0, sizes.sum()))
        assert abs(sizes[mixing.nearest(sizes, room)].sum() - room) <= 20
    assert mixing.nearest(np.array([5, 1600, 20, 99]), 1150).tolist() == [False, True, False, False]


def test_targets_share_excess_by_weight():
    want = mixing.targets({"a": 100, "b": 1000, "c": 900, None: 0})
    assert want["a"] == 300 and want[None] == 0
    assert abs(want["b"] - 1700 * 2 / 3) < 1e-9 and abs(sum(want.values()) - 2000) < 1e-9
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0}) == {"a": 0.0}


def test_flow_serves_overlapping_sources_and_spreads_repetition():
    found = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 15})
    assert sum(found[p]["a"] for p in found if "a" in p) == 15
    assert sum(found[p]["b"] for p in found if "b" in p) == 15
    assert all(sum(f.values()) == 10 for f in found.values())  # nothing twice while something is unused


def test_overlapping_documents(spark):
    rows = [(i, 10, ["a"] if i < 10 else ["b", "a", None] if i < 20 else [None]) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    got = {r.doc_id: r.taken for r in mixing.mix(frame, {"a": 150, "b": 30, None: 60}).collect()}
    assert sum(got.values()) == 240 and set(got.values()) <= {0, 10, 20}


def test_odd_rows(spark, nasty):
    rows = mixing.mix_sources(nasty).collect()
    check(rows, [(r.doc_id, r.text, r.lang, r.source) for r in nasty.collect()])
    assert mixing.mix_sources(nasty.limit(0)).count() == 0
    doubled = mixing.mix_sources(nasty.union(nasty)).collect()
    assert len(doubled) == 2 * nasty.count()
