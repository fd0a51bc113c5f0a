import re

import numpy as np

from plumbline.llm import pii, queries
from tests.llm import brute
from tests.llm.conftest import FOLDER


def base(text):
    """The contract's patterns, searched plainly."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) < 256 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


ODD = [
    "a@b.c.d@e.f", "@x.y", "a@b", "..@a-b.c-d.", "é@x.de", "1.2.3.4.5", "256.1.1.1 001.02.3.4", "1..2.3.4.5",
    "4111 1111 1111 1111", "4111-1111 1111-1111x", "+1 (555) 123-4567.", "+12345678", "++12 345 6789 0", "+1((((((((2",
    "call 555-234-6789 now", "mail john [at] host [dot] com ok", "😀 a@b.cd 😀 10.0.0.1", "card 4111.1111.1111.1111.",
    "a" * 20000, "1" * 20000, "1." * 5000,
]


def test_base_spans_match_the_plain_patterns():
    for text in ODD[:-3]:
        assert pii.base_spans(text) == base(text), text
    assert [pii.base_spans(t) for t in ODD[-3:]] == [[], [], pii.base_spans("1." * 5000)]


def test_query_matches_brute_force(spark, documents):
    got = {r.doc_id: r for r in queries.op4_pii(spark, FOLDER).collect()}
    assert len(got) == len(documents)
    for d, text, *_ in documents:
        want, r = base(text), got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == brute.sha(joined)
        assert set(joined.split(",")) <= set(r.spans.split(",")) or not want


def test_labelers_that_agree_are_found_reliable():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < right, np.where(truth, 1, -1), np.where(truth, -1, 1))
                      for right in (0.95, 0.9, 0.85, 0.6, 0.9, 0.8)], 1)
    rows, n = np.unique(votes, axis=0, return_counts=True)
    _, table = pii.SpanModel.estimate(rows, n.astype(float))
    found = [table[j][1][2] for j in range(6)]
    assert all(abs(f - w) < 0.07 for f, w in zip(found, (0.95, 0.9, 0.85, 0.6, 0.9, 0.8)))


def test_added_spans_and_mask(spark):
    rows = [(i, f"mail me: a.b{i}@host.com or +1 (555) 234-67{i:02d}, from 10.1.2.{i}") for i in range(60)]
    rows += [(100 + i, f"call (555) 234-67{i:02d} soon") for i in range(20)]
    rows += [(200, "nothing here"), (201, None), (202, "version 300.1.2.4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert sum(len(got[100 + i].spans) == 1 for i in range(20)) == 20 and not got[100].base
    assert not got[200].spans and not got[201].spans and not got[202].spans
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[3] == "mail me: <email> or <phone>, from <ip>" and masked[201] is None


def test_odd_rows(spark, nasty):
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    both = nasty.unionByName(odd, allowMissingColumns=True)
    got = {r.doc_id: r for r in pii.find(both).collect()}
    assert len(got) == both.count()
    for r in both.collect():
        if not r.text or len(r.text) < 9000:
            kinds = [(x.start, pii.KINDS.index(x.kind), x.end) for x in got[r.doc_id].base]
            assert kinds == base(r.text)
    assert pii.find(nasty.limit(0)).count() == 0 and pii.mask(nasty.limit(0)).count() == 0
    assert pii.mask(nasty.union(nasty)).count() == 2 * nasty.count()
