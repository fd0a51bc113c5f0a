import random

import pyarrow as pa

from plumbline.llm import passages, queries
from plumbline.llm.words import Words
from tests.llm import brute
from tests.llm.conftest import FOLDER


def check(rows, docs):
    want = brute.removed(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}
    assert got == want


def run(frame):
    from pyspark.sql import functions as F

    return passages.remove_repeats(frame).withColumn("kept_sha256", F.sha2("kept", 256)).collect()


def test_query_matches_brute_force(spark, documents):
    check(queries.op5_repeated_passages(spark, FOLDER).collect(), [(d[0], d[1]) for d in documents])


def test_shared_cut_and_overlapping_passages(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK_BYTES", 4000)
    rng = random.Random(8)
    pool = [[f"p{i}w{rng.randrange(9999)}" for _ in range(rng.randrange(49, 160))] for i in range(12)]
    docs = []
    for d in range(80):
        words = []
        for _ in range(rng.randrange(1, 4)):
            part = rng.choice(pool)
            a = rng.randrange(0, len(part) - 30)
            words += part[a : a + rng.randrange(30, 130)]
            words += [f"d{d}x{rng.randrange(9999)}" for _ in range(rng.randrange(0, 30))]
        docs.append((d * 3, rng.choice([" ", "\n", " \t "]).join(words)))
    docs += [(1000, "again " * 700), (1001, "x " + "again " * 300 + "y"), (1002, docs[5][1]), (2, docs[5][1])]
    check(run(spark.createDataFrame(docs, "doc_id long, text string")), docs)


def test_odd_rows(spark, nasty):
    docs = [(r.doc_id, r.text) for r in nasty.collect()]
    check(run(nasty), docs)
    assert passages.remove_repeats(nasty.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(80))
    frame = spark.createDataFrame([(None, long), (None, long), (4, long), (4, long), (9, long)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in run(frame))
    assert got == [(0, 0), (0, 0), (4, 0), (4, 0), (9, 80)]


def test_locator_needs_no_alignment():
    passage = " ".join(f"w{i}" for i in range(90))
    found = passages.Locator([1], pa.array([passage]))
    text = "a b c " + " ".join(f"w{i}" for i in range(13, 70)) + " d"
    ids = found.ids(Words.of(pa.array([text])).hashes())
    assert found.covered(2, ids).tolist() == [False] * 3 + [True] * 57 + [False]
    assert not found.covered(1, ids).any() and not found.covered(None, ids).any()
    assert not passages.Locator([], pa.array([], pa.string())).covered(5, ids).any()
