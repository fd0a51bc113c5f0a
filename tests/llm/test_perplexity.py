import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from plumbline.llm import perplexity, queries
from plumbline.llm.words import Words, text_bytes
from tests.llm import brute
from tests.llm.conftest import FOLDER, NASTY


def test_query_matches_brute_force(spark, documents):
    got = {r.doc_id: r for r in queries.op9_quality_perplexity(spark, FOLDER).collect()}
    assert len(got) == len(documents)
    for d, text, *_ in documents:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_quality(text)
        assert not (r.kept and r.base_failed)
        assert r.kept == (not r.base_failed and r.low <= math.log2(r.perplexity) <= r.high)
    clean = [r for r in got.values() if not r.base_failed]
    assert sum(r.kept for r in clean) > 0.9 * len(clean)


def test_words_of_odd_texts():
    w = Words.of(pa.array(NASTY))
    for i, text in enumerate(NASTY):
        found = [w.raw[w.starts[j] : w.ends[j]].tobytes().decode() for j in range(w.rows[i], w.rows[i + 1])]
        assert found == brute.words(text)
    h = w.hashes()
    names = [w.raw[a:b].tobytes() for a, b in zip(w.starts, w.ends)]
    assert len(set(h.tolist())) == len(set(names))
    assert all(h[i] == h[names.index(n)] for i, n in enumerate(names))
    g = w.grams(h, 7)
    assert len(g) == len(h) - 6


def test_byte_grams():
    column = pa.array(["abcdefg", "", "é", None, "z"])
    want = []
    for t in column.to_pylist():
        b = (t or "").encode()
        want += [int.from_bytes(b[max(0, i - 4) : i + 1], "big") for i in range(len(b))]
    assert perplexity.byte_grams(*text_bytes(column), 5).tolist() == want


def test_probabilities_sum_to_one_and_joins_agree(spark):
    rows = [(i, t, "en") for i, t in enumerate(["abracadabra abra", "banana band", "aaaa", "cabbage", "dab a cab " * 9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = perplexity.kneser_ney(perplexity.count_grams(docs, 3), 3).cache()
    held = perplexity.SortedModel(model.toArrow(), 3)
    for history in (b"ab", b"zz", b"an"):
        codes = np.array([(history[0] << 16) | (history[1] << 8) | b for b in range(256)], np.uint64)
        assert abs(np.exp(held.log_probabilities("en", codes)).sum() - 1) < 1e-3
    unseen = docs.unionByName(spark.createDataFrame([(9, "zebra qux", "en"), (10, "abra", "xx"), (11, "", "en")], docs.schema))
    a = {r.doc_id: r.loglik for r in perplexity.measures(unseen, model, 3).collect()}
    b = {r.doc_id: r.loglik for r in perplexity.measures(unseen, model, 3, entries=0).collect()}
    assert all(abs(a[k] - (b[k] or 0)) < 1e-3 for k in a)


def test_odd_rows(spark, nasty):
    got = {r.doc_id: r for r in perplexity.quality(nasty).collect()}
    assert len(got) == nasty.count()
    for r in nasty.collect():
        o = got[r.doc_id]
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words, o.base_failed) == brute.base_quality(r.text)
        assert o.perplexity is not None or not r.text
    assert perplexity.quality(nasty.limit(0)).count() == 0


def test_junk_is_rejected(spark):
    folder = "/root/testdata/sf0.01"
    rows = perplexity.quality(spark.read.parquet(f"{folder}/documents.parquet")).join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("not base_failed").select("quality", "kept").collect()
    poor, good = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert poor.count(False) >= 0.2 * len(poor) > 0, (poor.count(False), len(poor))
    assert good.count(False) <= 0.02 * len(good), (good.count(False), len(good))


def test_copies_do_not_narrow_the_band(spark):
    rows = [(i, "en", 1000 + i, 200, 800, 4.0 + i / 100, False) for i in range(101)]
    schema = "doc_id long, lang string, n_bytes long, n_words long, word_chars long, bits double, base_failed boolean"
    once = spark.createDataFrame(rows, schema)
    many = once.unionByName(spark.createDataFrame([rows[50]] * 900, schema))
    assert perplexity.bands(many).collect() == perplexity.bands(once).collect()
    assert 4.75 < perplexity.bands(once).first().high < 4.75 + 3 * 0.5


def test_joined_scores_of_repeated_and_null_ids(spark):
    texts = ["abracadabra abra", "banana band", "dab a cab " * 9, "cabbage", "aaaa", "aaaa", ""]
    ids = [1, 1, 1, None, None, 2, 2]
    docs = spark.createDataFrame([(i, t, "en") for i, t in zip(ids, texts)], "doc_id long, text string, lang string")
    model = perplexity.kneser_ney(perplexity.count_grams(docs, 3), 3).cache()
    found = [sorted((r.doc_id or 0, r.n_bytes, round(r.loglik, 3)) for r in perplexity.measures(docs, model, 3, **how).collect())
             for how in ({}, {"entries": 0})]
    assert [f[:2] for f in found[0]] == [f[:2] for f in found[1]]
    assert all(abs(a[2] - b[2]) < 2e-3 for a, b in zip(*found))


def plain_kneser_ney(texts, order):
    """Modified Kneser-Ney over bytes from its definition: the log probability of a byte after a history."""
    grams = defaultdict(Counter)  # length -> n-gram -> count; at a text's start nothing comes before, which is byte 0
    for t in texts:
        padded = bytes(order - 1) + t
        for i in range(len(t)):
            grams[order][padded[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1
    takes = {}
    for k in grams:
        seen = Counter(grams[k].values())
        y = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] + 2 * seen[2] else None
        takes[k] = {}
        for i in (1, 2, 3):
            d = i - (i + 1) * y * seen[i + 1] / seen[i] if y is not None and seen[i] else None
            takes[k][i] = d if d is not None and 0.01 <= d <= i else i / 2

    def p(byte, history):
        below = p(byte, history[1:]) if history else 1 / 256
        k = len(history) + 1
        held = {g: n for g, n in grams[k].items() if g[:-1] == history}
        if not held:
            return below
        total, freed = sum(held.values()), sum(takes[k][min(n, 3)] for n in held.values())
        n = held.get(history + bytes([byte]), 0)
        return max(n - takes[k][min(n, 3)] if n else 0, 0) / total + freed / total * below

    return lambda t: sum(math.log(p(b, (bytes(order - 1) + t)[i : i + order - 1])) for i, b in enumerate(t))


def test_scores_equal_a_plain_model(spark):
    texts = ["abracadabra abra", "banana band", "aaaa", "cabbage", "dab a cab " * 9, "a bad cab ran", "zzz"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    score = plain_kneser_ney([t.encode() for t in texts], 3)
    model = perplexity.kneser_ney(perplexity.count_grams(docs, 3), 3)
    other = docs.unionByName(spark.createDataFrame([(7, "qux abra", "en"), (8, "x", "en")], docs.schema))
    got = {r.doc_id: r.loglik for r in perplexity.measures(other, model, 3).collect()}
    for i, t in enumerate([*texts, "qux abra", "x"]):
        assert abs(got[i] - score(t.encode())) < 1e-5 * len(t), (t, got[i], score(t.encode()))


def test_one_score_on_every_path_and_split(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    model = perplexity.kneser_ney(perplexity.count_grams(docs, 4), 4).cache()
    ways = [perplexity.measures(docs, model, 4), perplexity.measures(docs.repartition(7), model, 4),
            perplexity.measures(docs, model, 4, entries=0)]
    found = [sorted((r.doc_id, r.n_bytes, r.loglik) for r in way.collect()) for way in ways]
    assert found[0] == found[1] == found[2]
    again = perplexity.kneser_ney(perplexity.count_grams(docs.repartition(5), 4), 4)
    assert sorted(model.collect(), key=str) == sorted(again.collect(), key=str)


def test_different_texts_of_equal_measures_count_apart(spark):
    rows = [(i, "en", 1000, 200, 800, 4.5 if i < 50 else 5.0, False, i) for i in range(100)]
    schema = "doc_id long, lang string, n_bytes long, n_words long, word_chars long, bits double, base_failed boolean, digest long"
    docs = spark.createDataFrame(rows + [rows[0]] * 900, schema)
    limits = perplexity.bands(docs, copies=("digest", "n_bytes", "n_words")).first()
    assert limits.high > 5.0 + 2 * 0.5 > limits.low
