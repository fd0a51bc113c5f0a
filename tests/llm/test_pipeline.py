from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import mixing, pii
from tests.llm import brute
from tests.llm.conftest import FOLDER


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER)
        if name != "best-fit packing":
            assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = before, docs
    before, after = kept["quality rules"]
    ok = {r.doc_id for r in before.collect() if not brute.base_quality(r.text)[5]}
    left = {r.doc_id for r in after.collect()}
    assert left <= ok and len(left) > 0.9 * len(ok)
    before, after = kept["n-gram Jaccard join"]
    classes = brute.links([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {c for c, _ in classes.values()}
    before, after = kept["PII"]
    texts = {r.doc_id: r for r in after.collect()}
    assert set(texts) == {r.doc_id for r in before.collect()}
    for r in before.collect():
        assert not pii.base_spans(texts[r.doc_id].text) and texts[r.doc_id].n_chars == len(texts[r.doc_id].text)
        assert pii.base_spans(r.text) or r.text == texts[r.doc_id].text or "<" in texts[r.doc_id].text
    before, after = kept["mixing sources"]
    rows = before.collect()
    totals: dict = {}
    for r in rows:
        totals[r.source] = totals.get(r.source, 0) + len(brute.words(r.text))
    got, times = {}, {}
    for r in after.collect():
        got[r.source] = got.get(r.source, 0) + len(brute.words(r.text))
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    largest = max(len(brute.words(r.text)) for r in rows)
    assert max(times.values()) <= 3
    assert all(abs(got.get(s, 0) - t) <= largest for s, t in mixing.targets(totals).items())
    before, after = kept["best-fit packing"]
    pieces = after.collect()
    assert sum(1 for r in pieces if r.piece == 0) == before.count()
    once = {r.doc_id: r.text for r in before.collect() if times[r.doc_id] == 1}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    for d, text in list(once.items())[:40]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        mine = sorted((r for r in pieces if r.doc_id == d), key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == brute.ids_crc32(ids[r.start : r.start + r.length]) for r in mine)


def test_run_and_odd_rows(spark, nasty):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    some = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id between 60 and 110").withColumn(
        "n_chars", F.col("n_chars").cast("int"))
    docs = nasty.unionByName(some, allowMissingColumns=True)
    for docs_in in (docs, docs.limit(0)):
        held = docs_in
        for _, stage in corpus_pipeline.STAGES:
            held = stage(spark, held, FOLDER)
            held = spark.createDataFrame(held.collect(), held.schema)
        assert (held.count() > 0) == (docs_in.count() > 0)


def test_rows_that_share_an_id(spark):
    words = lambda c: " ".join(f"{c}{i}" for i in range(80))
    rows = [(1, words("a")), (1, words("b")), (None, words("c")), (None, words("d")), (2, words("a")), (3, "too short"), (1, "no")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    texts = lambda frame: sorted(r.text for r in frame.collect())
    good = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    assert not {"too short", "no"} & set(texts(good))
    left = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted((i or 0, t) for i, t in rows if i != 2)
    some = spark.createDataFrame(left, docs.schema)
    assert set(texts(corpus_pipeline.mixed_sources(spark, some, FOLDER))) <= set(texts(some))
    assert max(Counter(texts(corpus_pipeline.mixed_sources(spark, some, FOLDER))).values()) <= 3


def test_extra_columns_come_back_as_they_were(spark):
    words = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, words, "en", "web", len(words), "mine", 7)],
                                 "doc_id long, text string, lang string, source string, n_chars int, _row string, _Row_ int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for r in stage(spark, docs, FOLDER).collect():
            assert (r["_row"], r["_Row_"]) == ("mine", 7)
