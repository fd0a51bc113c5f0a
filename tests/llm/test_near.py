import random
from fractions import Fraction

import numpy as np

from plumbline.llm import near, queries
from tests.llm import brute
from tests.llm.conftest import FOLDER


def check(rows, docs):
    want = brute.links(docs)
    got = {r.doc_id: (r.class_id, r.n_links) for r in rows}
    assert got == want
    sets = {d: brute.shingles(t) for d, t in docs}
    for r in rows:
        same = [d for d, s in sets.items() if s and s == sets[r.doc_id]]
        assert r.copy_id == min(same, default=r.doc_id)


def test_query_matches_brute_force(spark, documents):
    check(queries.op7_jaccard_join(spark, FOLDER).collect(), [(d[0], d[1]) for d in documents])


def copies(n=300, words=120, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(6)):
            text[rng.randrange(words)] = f"x{rng.randrange(40)}"
        out.append((i, " ".join(text)))
    return out


def test_a_large_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 40)
    monkeypatch.setattr(near, "VERIFY", 50)
    docs = copies() + [(1000 + i, " ".join(f"q{i * 200 + k}" for k in range(80))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check(near.join(frame).collect(), docs)


def test_odd_rows(spark, nasty):
    rows = near.join(nasty).collect()
    check(rows, [(r.doc_id, r.text) for r in nasty.collect()])
    assert near.join(nasty.limit(0)).count() == 0
    twice = near.join(nasty.filter("doc_id in (3, 1)").union(nasty.filter("doc_id = 3"))).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in twice) == [(1, 1, 0), (3, 3, 1), (3, 3, 1)]
    nameless = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f g")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_links) for r in near.join(nameless).collect()) == [(0, 1), (0, 1), (5, 0)]


def test_pruning_keeps_pairs_at_the_threshold():
    least = near.least_matches(0.8)
    assert least[near.HASHES] <= 0.8 * near.HASHES and least == sorted(least)
    rng = np.random.default_rng(1)
    kept = 0
    for _ in range(300):
        shared = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        sets = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 50).astype(np.uint64)])) for _ in range(2)]
        sig = near.signatures(np.concatenate(sets), np.array([0, len(sets[0])]))
        kept += len(near.surviving_pairs(sig[:1], sig[1:], least, False)[0])
    assert kept == 300
    other = near.signatures(rng.integers(0, 1 << 63, 900).astype(np.uint64), np.array([0, 450]))
    assert not len(near.surviving_pairs(other[:1], other[1:], least, False)[0])


def test_exact_intersections():
    a, b = np.arange(0, 90, dtype=np.uint64), np.arange(10, 100, dtype=np.uint64)
    assert near.linked([a], [b], Fraction(4, 5)).tolist() == [[True]]  # 80 of 100
    assert near.linked([a], [b], Fraction(801, 1000)).tolist() == [[False]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_different_texts_that_share_an_id(spark):
    base, other = ([f"{c}{i}" for i in range(60)] for c in "ab")
    near_base, near_other = (w[:-1] + ["changed"] for w in (base, other))
    for shared in (1, None):
        docs = [(shared, " ".join(base)), (shared, " ".join(other)), (5, " ".join(near_base)), (6, " ".join(near_other))]
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        got = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in near.join(frame).collect())
        if shared:
            assert got == [(1, 1, 1), (1, 1, 1), (5, 1, 1), (6, 1, 1)]
        else:
            assert got == [(0, 5, 1), (0, 6, 1), (5, 5, 1), (6, 6, 1)]
