"""
Grouping of spelling variants: words one edit apart, found with asymmetric q-chunks.

1. Tasks count the terms of each document and send one row per word. ``altered`` may change a term of a document first.
2. A word of T code points contributes two disjoint chunks of q = T div 2: its first and its last q. One inserted, deleted or
   replaced code point damages one of them at most. The other word contributes its positional grams of that
   length; a chunk is found in them at its own place or, behind an inserted code point, one further on. Which of both follows
   from the lengths, so only the grams at these places are sent: for partners of T code points and of T - 1.
3. Words that share a chunk are joined and verified by their edit distance. A chunk that more than ``HOT`` words share is
   not joined: what is left of these words beside the chunk is again one edit apart, so it contributes two
   chunks of its own, and so on. At the last step one code point is left and every pair is a link, so work stays in
   proportion to words and links.
4. A word's form is its most frequent near word, if that one is at least ``RATIO`` times as frequent. Counts at least double
   with every step, so six rounds of pointer doubling reach the end of any chain of forms.

Defined results: null and empty texts have no words; repeated rows count again; equal counts are settled by code-point order; a
word without a form is its own root; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.terms import Terms, latin_letters
from plumbline.llm.words import slices, text_bytes
from plumbline.session import scratch

SHORTEST = 5
LEAST = 3
RATIO = 2
HOT = 128
ROUNDS = 6  # 2^6 steps; a 64-bit count can't double more often

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1).astype(np.uint32)


def crc32_after(state: np.ndarray, words: pa.Array, which: np.ndarray) -> np.ndarray:
    """CRC-32 of what gave ``state`` and the chosen word's bytes behind it."""
    raw, offsets = text_bytes(words)
    start, length = offsets[which], np.diff(offsets)[which]
    crc = ~state.astype(np.uint32)
    todo, k = np.flatnonzero(length > 0), 0
    while len(todo):
        crc[todo] = (crc[todo] >> np.uint32(8)) ^ _TABLE[(crc[todo] ^ raw[start[todo] + k]) & np.uint32(255)]
        k += 1
        todo = todo[length[todo] > k]
    return ~crc


def misspelt(prefixes: pa.Array, terms: Terms, every: int) -> tuple[np.ndarray, list[str]]:
    """Which of a slice's terms lose a code point, by the CRC-32 of ``<prefix>:<term>``, and what is left of them."""
    heads = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in prefixes.to_pylist()], np.uint32)
    crc = crc32_after(heads[terms.row], terms.words, terms.term)
    hit = np.flatnonzero(crc % np.uint32(every) == 0)
    left = []
    for value, word in zip(crc[hit].tolist(), terms.words.take(pa.array(terms.term[hit])).to_pylist()):
        at = value % len(word)
        left.append(word[:at] + word[at + 1:])
    return hit, left


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, id: str = "doc_id", text: str = "text",
                altered: Callable[[pa.Array, Terms], tuple[np.ndarray, list[str]]] | None = None) -> DataFrame:
    """(word, n) of all words long and frequent enough; ``altered`` names terms of documents to be read otherwise."""

    def work(batches):
        for batch in slices(batches, "text"):
            found = Terms.of(batch.column("text"), latin_letters)
            count = found.count.copy()
            if altered is not None and len(count):
                hit, other = altered(batch.column("id"), found)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(other, pa.string()), pa.array(count[hit].astype(np.int64))], ["word", "n"])
                    count[hit] = 0
            total = np.bincount(found.term, count, len(found.words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([found.words, pa.array(total)], ["word", "n"])

    each = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(work, "word string, n bigint")
    return each.filter((F.col("n") > 0) & (F.char_length("word") >= shortest)).groupBy("word").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= least)


def _chunked(rows: DataFrame) -> DataFrame:
    """The same rows with a longer key, once for each of their two chunks; ``m`` code points of ``rest`` were the shorter word's."""
    q = "m div 2"
    return rows.selectExpr("word", "n", "own", "m", "rest", "key", f"{q} AS q", "char_length(rest) AS here").selectExpr(
        "word", "n", "own", "m - q AS m",
        "explode(array(struct(concat(key, '<', substring(rest, 1, cast(q AS int))) AS key, substring(rest, cast(q + 1 AS int)) AS rest),"
        " struct(concat(key, '>', substring(rest, cast(here - q + 1 AS int))) AS key, substring(rest, 1, cast(here - q AS int)) AS rest))) AS at"
    ).selectExpr("word", "n", "own", "m", "at.key", "at.rest")


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n, other, other_n): every two words one edit apart, both ways; words: (word, n), words all different."""
    spark = words.sparkSession

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(path := scratch(spark, name))
        return spark.read.parquet(path)

    # own: the word has the partner length itself and gives chunks; otherwise it is one longer and gives grams only.
    sized = words.withColumn("size", F.char_length("word").cast("bigint"))
    rows = sized.select("word", "n", F.explode(F.array(F.lit(True), F.lit(False))).alias("own"), "size").selectExpr(
        "word", "n", "own", "if(own, size, size - 1) AS m", "word AS rest").filter("m >= 1").withColumn("key", F.col("m").cast("string"))
    found, level = [], 0
    while rows is not None:
        rows = stored(_chunked(rows.filter("m > 1")) if level == 0 else _chunked(rows), f"chunks-{level}")
        crowded = stored(rows.groupBy("key").agg(F.count("*").alias("members"), F.max("m").alias("left")).filter(
            (F.col("members") > hot) & (F.col("left") > 1)).select("key"), f"crowded-{level}")
        more = not crowded.isEmpty()
        cold = rows.join(crowded, "key", "left_anti") if more else rows
        mine, theirs = cold.filter("own").alias("x"), cold.alias("y")
        found.append(mine.join(theirs, F.expr("x.key = y.key AND (NOT y.own OR x.word < y.word)")).filter(
            "levenshtein(x.rest, y.rest, 1) = 1").selectExpr("x.word", "x.n", "y.word AS other", "y.n AS other_n"))
        rows = rows.join(crowded, "key", "left_semi") if more else None
        level += 1
    pairs = found[0]
    for frame in found[1:]:
        pairs = pairs.unionByName(frame)
    pairs = pairs.distinct()  # two undamaged chunks find a pair twice
    return pairs.unionByName(pairs.selectExpr("other AS word", "other_n AS n", "word AS other", "n AS other_n"))


def forms(words: DataFrame, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; words: (word, n), words all different."""
    spark = words.sparkSession

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(path := scratch(spark, name))
        return spark.read.parquet(path)

    words = stored(words, "words")
    best = near_pairs(words, hot).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    near = stored(words.join(best, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0) AS n_near", f"if(-best.less >= {ratio} * n, best.other, NULL) AS form",
        f"if(-best.less >= {ratio} * n, -best.less, NULL) AS form_n"), "forms")
    led = near.filter("form IS NOT NULL").selectExpr("word", "form AS root")
    for _ in range(ROUNDS):
        led = stored(led, "roots")
        ahead = led.selectExpr("word AS _at", "root AS _root")
        step = led.join(ahead, F.col("root") == F.col("_at"))
        if step.isEmpty():
            break
        led = led.join(ahead, F.col("root") == F.col("_at"), "left").selectExpr("word", "coalesce(_root, root) AS root")
    return near.join(led, "word", "left").selectExpr("word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n")
