import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import suffixes


def brute(docs, window=200):
    """docs: (doc_id, text) -> Counter of (doc_id, n_bytes, n_removed, n_spans, digest)"""
    raw = [(d, (t or "").encode()) for d, t in docs]
    n = Counter(b[i : i + window] for _, b in raw for i in range(len(b) - window + 1))
    out = Counter()
    for d, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if n[b[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out[d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def result(spark, docs, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "1 AS id", "'x' AS raw", "2 AS n_bytes", "3 AS own", "4 AS kept")
    found = suffixes.remove_repeats(frame, lambda kept: F.sha2(kept, 256), **options)
    return Counter(map(tuple, found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()))


def test_given_documents(spark, documents):
    docs = [(d, t) for d, t, _, _ in documents]
    assert result(spark, docs) == brute(docs)


def test_odd_rows(spark, nasty):
    docs = [(r["doc_id"], r["text"]) for r in nasty.collect() if len(r["text"] or "") < 9000]
    docs += [(None, "word " * 300), (None, None), (60, "é" * 150), (61, "aé" + "é" * 120), (62, "z" * 200), (63, "z" * 199)]
    docs += [(64, "x" * 700 + "y"), (64, "y" + "x" * 201)]
    assert result(spark, docs) == brute(docs)
    assert not result(spark, docs[:0])


@pytest.mark.parametrize("options", [{}, {"hot": 3, "bucket": 3000, "block": 50}, {"hot": 1, "bucket": 100, "block": 1, "k": 8}])
def test_a_passage_in_a_third_of_all_documents(spark, options):
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    hot, nearly, base = text(330), text(195), text(900)
    docs = [(i, text(int(rng.integers(0, 300)))) for i in range(10)]
    docs += [(20 + i, text(90 + i) + hot + text(70)) for i in range(12)]  # one passage in different surroundings
    docs += [(40 + i, text(50) + nearly + text(60)) for i in range(12)]  # too short to be removed
    docs += [(60 + i, base[: 60 * i] + "#" * (i + 1) + base[60 * i :]) for i in range(10)]  # near copies
    docs += [(80, base), (81, base), (82, hot * 3), (83, hot[:199]), (84, hot[5:205] * 2)]
    assert result(spark, docs, **options) == brute(docs)


def test_suffixes_are_in_order():
    rng = np.random.default_rng(8)
    raw = np.concatenate([rng.integers(97, 99, 700), np.tile([97, 98, 97], 200), rng.integers(97, 99, 300)]).astype(np.uint8)
    raw = np.concatenate([raw, raw[100:500]])
    text = np.concatenate([raw, np.zeros(40 + 16 * suffixes.PERIOD, np.uint8)])
    starts, rank = np.arange(len(raw) - 40), suffixes.cover_ranks(text, len(raw), 40)
    for block in (1, 100, 10**6):
        order = np.concatenate([at for at, _ in suffixes.sorted_blocks(text, starts, rank, block)])
        found = [raw[i : i + 40].tobytes() for i in order]
        assert found == sorted(found) and len(set(order.tolist())) == len(starts)
    want = [i for i in starts if sum(raw[j : j + 40].tobytes() == raw[i : i + 40].tobytes() for j in starts) > 1]
    assert suffixes.repeated_windows(raw, starts, 40, 64).tolist() == want


def test_the_cover_is_perfect():
    shifts = {(b - a) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert shifts == set(range(suffixes.PERIOD)) and suffixes.SHIFT.max() < suffixes.PERIOD
