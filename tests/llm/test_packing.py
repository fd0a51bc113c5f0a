import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing, queries
from tests.llm import brute
from tests.llm.conftest import FOLDER


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check(rows, texts, tokenizer):
    """rows: (doc_id, piece, start, length, crc, sequence, offset); texts: doc_id -> text."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_sequence.setdefault(r[5], []).append(r)
    assert set(by_doc) == set(texts)
    for d, mine in by_doc.items():
        ids = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, r in enumerate(sorted(mine, key=lambda r: r[1])):
            assert (r[1], r[2]) == (k, at)
            assert r[4] == brute.ids_crc32(ids[at : at + r[3]])
            assert r[3] == 1024 or k == 0
            at += r[3]
        assert at == len(ids)
        assert len(ids) > 1024 or len(mine) == 1
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r[6]):
            assert r[6] == at
            at += r[3]
        assert at <= 1024
    return len(by_sequence), -(-sum(r[3] for r in rows) // 1024)


def test_query_matches_the_tokenizer(spark, documents, tokenizer):
    rows = [tuple(r) for r in queries.op2_packing(spark, FOLDER).collect()]
    used, least = check(rows, {d[0]: d[1] for d in documents}, tokenizer)
    assert used <= least + 3  # one unfilled sequence in each task at most


def test_odd_rows(spark, nasty, tokenizer):
    got = queries.packing_digest(packing.pack(nasty, queries.vocabulary())).collect()
    check([tuple(r) for r in got], {r.doc_id: r.text for r in nasty.collect()}, tokenizer)
    assert queries.packing_digest(packing.pack(nasty.limit(0), queries.vocabulary())).count() == 0
    twice = packing.pack(nasty.filter("doc_id = 3").union(nasty.filter("doc_id = 3")), queries.vocabulary())
    assert twice.count() == 2


def test_blocks_carry_what_is_unfilled(spark, documents, tokenizer):
    frame = spark.createDataFrame([(d[0], d[1]) for d in documents], "doc_id long, text string").coalesce(1)
    got = queries.packing_digest(packing.pack(frame, queries.vocabulary(), block=5000)).collect()
    used, least = check([tuple(r) for r in got], {d[0]: d[1] for d in documents}, tokenizer)
    assert used <= least * 1.03


def test_exchanges_beat_best_fit():
    random.seed(5)
    won = 0
    for low, high in ((1, 1023), (300, 700), (200, 500)):
        sizes = np.array([random.randint(low, high) for _ in range(2000)])
        which, offset, fills = packing.pack_sizes(sizes)
        assert (np.bincount(which, weights=sizes) == fills).all() and fills.max() <= 1024
        plain = len(packing.best_fit(sizes.tolist(), 1024))
        assert len(fills) <= plain
        won += plain - len(fills)
    assert won > 0
