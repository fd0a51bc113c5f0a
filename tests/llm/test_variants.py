import re
import zlib
from collections import Counter
from functools import partial

import pyarrow as pa
import numpy as np
import pytest

from plumbline.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def counts(docs, every=97, shortest=5, least=3):
    """docs: (doc_id, text)"""
    n = Counter()
    for doc_id, text in docs:
        for run in RUN.findall((text or "").translate(UPPER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(n, ratio=2):
    form, near = {}, {}
    for w in n:
        near[w] = [x for x in n if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def result(frame):
    return sorted((tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_counts(spark, documents, nasty):
    docs = [(d, t) for d, t, _, _ in documents] + [(None, "Gamma gamma GAMMA"), (None, None), (7, "ÀÉÎõü ÀÉÎõü àÉÎõü × ÷÷÷÷÷÷ ÷÷÷÷÷÷ ÷÷÷÷÷÷")]
    docs += [(r["doc_id"], r["text"]) for r in nasty.collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'q' AS word")
    for every in (97, 3):
        found = variants.word_counts(frame, altered=partial(variants.misspelt, every=every))
        assert {r["word"]: r["n"] for r in found.collect()} == counts(docs, every)
    assert variants.word_counts(frame.limit(0)).count() == 0


def test_crc_of_many_words():
    words = ["", "a", "ÿ" * 30, "word", "x" * 5000]
    heads = np.array([zlib.crc32(b"12:")] * len(words), np.uint32)
    found = variants.crc32_after(heads, pa.array(words), np.arange(len(words)))
    assert found.tolist() == [zlib.crc32(f"12:{w}".encode()) for w in words]


@pytest.mark.parametrize("hot", [128, 1])
def test_forms_match_brute_force(spark, hot):
    rng = np.random.default_rng(11)
    words = {"".join(rng.choice(list("abé"), int(rng.integers(5, 9)))): int(rng.integers(3, 40)) for _ in range(700)}
    words |= {"q" * 12: 4, "q" * 13: 8, "q" * 14: 16, "q" * 15: 32, "lonely": 3, "z" * 4000: 3, "z" * 4001: 9}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(variants.forms(frame, hot=hot)) == brute(words)


def test_long_chains_ties_and_nothing(spark):
    chain = {"c" * (5 + i): 3 * 2**i for i in range(40)}
    chain |= {"tiers": 3, "tierx": 9, "tiera": 9}
    frame = spark.createDataFrame(list(chain.items()), "word string, n long")
    found = {r[0]: r for r in result(variants.forms(frame, hot=2))}
    assert sorted(found.values(), key=str) == brute(chain)
    assert found["c" * 5][2] == "c" * 44 and found["tiers"][1] == "tiera"
    assert variants.forms(frame.limit(0)).count() == 0
