"""
Divergence audit of a language's sources by one-hot level products.

1. Tasks count each document's terms and send one row per (language, source, term): occurrences, documents.
2. A term is kept for a language if enough of its documents hold it. Each group (language, source) gives a kept
   term the smoothed share p(count) in parts of ``SCALE``, the language as a whole gives it q.
3. The terms of a language are dealt into blocks. In a block, every (source, count) pair that occurs is an indicator column over
   the terms; the product of that 0/1 matrix with its transpose says for every two columns how many terms have both
   levels. Summed over blocks these are the joint tables of all pairs of sources, and the diagonal tables are
   the levels of each source.
4. A pair's divergence is the price f(p, q) of each cell times its terms. Count 0 needs no column: what a table lacks is in its
   margins, so with f00 the price of two zero counts the sum over all V kept terms is

       V f00 + sum_a n_a (f_a0 - f00) + sum_b n_b (f_0b - f00) + sum_ab n_ab (f_ab - f_a0 - f_0b + f00).

Matrices hold at most ``BLOCK_ROWS`` counts on average and are cut into tiles of few columns, so memory doesn't depend on the
corpus; entries are sums of at most 2^24 ones, exact in single precision. Prices are whole numbers: products of
counts and ``SCALE`` in decimals, the rest in 64 bits, sums in decimals.

Defined results: null text, language or source are read as ''; every row is a document of its own, repeated or not; a
group without terms is priced all the same; a language without kept terms has pairs of value 0 and no terms; a language of one
source has no pairs; equal values are ranked by the item's bytes; an empty table gives an empty result; other columns are neither
read nor returned.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.terms import Terms, letters_and_wide
from plumbline.llm.words import slices
from plumbline.session import scratch

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
BLOCK_ROWS = 50_000  # counts in a block of terms, on average
TILE_COLUMNS = 512  # new columns of a tile


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, held): occurrences of a term in a group, and documents of it that hold the term."""

    def work(batches):
        for batch in slices(batches, "text"):
            found = Terms.of(batch.column("text"), letters_and_wide)
            if not len(found.row):
                continue
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            key = code[found.row] * len(found.words) + found.term
            keys, where = np.unique(key, return_inverse=True)
            group = keys // len(found.words)
            yield pa.RecordBatch.from_arrays([
                lang.dictionary.take(pa.array(group // len(source.dictionary))),
                source.dictionary.take(pa.array(group % len(source.dictionary))),
                found.words.take(pa.array(keys % len(found.words))),
                pa.array(np.bincount(where, found.count).astype(np.int64)), pa.array(np.bincount(where).astype(np.int64)),
            ], ["lang", "source", "term", "n", "held"])

    each = docs.mapInArrow(work, "lang string, source string, term string, n bigint, held bigint")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def level_products(source: np.ndarray, term: np.ndarray, n: np.ndarray, tile: int = TILE_COLUMNS
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left source, its level, right source, its level, terms) of one block; left columns are not after right ones."""
    columns, column = np.unique(np.stack([source, n]), axis=1, return_inverse=True)
    column = column.reshape(-1)
    # Terms of like size share levels: in order of size, a tile ends where it would see too many new columns.
    total = np.bincount(term, n)
    order = np.lexsort((column, term, total[term]))
    term, column = term[order], column[order]
    new = np.zeros(len(column), np.int64)
    new[np.unique(column, return_index=True)[1]] = 1
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    seen = (np.cumsum(new) - new)[starts] // tile  # of each term, in order
    at = np.repeat(seen, np.diff(np.append(starts, len(term))))
    keys, times = [], []
    for k in range(int(at[-1]) + 1) if len(at) else ():
        own = slice(*np.searchsorted(at, [k, k + 1]))
        if own.start == own.stop:
            continue
        rows = np.cumsum(np.append(0, term[own][1:] != term[own][:-1]))
        here, place = np.unique(column[own], return_inverse=True)
        hot = np.zeros((rows[-1] + 1, len(here)), np.float32)
        hot[rows, place] = 1
        joint = np.triu(hot.T @ hot)
        left, right = np.nonzero(joint)
        keys.append(here[left] * columns.shape[1] + here[right])
        times.append(joint[left, right].astype(np.int64))
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    terms = np.zeros(len(key), np.int64)
    np.add.at(terms, where, np.concatenate(times))
    left, right = key // columns.shape[1], key % columns.shape[1]
    return columns[0][left], columns[1][left], columns[0][right], columns[1][right], terms


def _products(block: pa.Table) -> pa.Table:
    names, source = np.unique(np.array(block.column("source").to_pylist(), object), return_inverse=True)
    _, term = np.unique(np.array(block.column("term").to_pylist(), object), return_inverse=True)
    left, a, right, b, terms = level_products(source, term, block.column("n").to_numpy())
    return pa.table({
        "lang": pa.array([block.column("lang")[0].as_py()] * len(terms), pa.string()),
        "left": pa.array(names[left], pa.string()), "a": pa.array(a), "right": pa.array(names[right], pa.string()),
        "b": pa.array(b), "terms": pa.array(terms)})


def _share(count: str, total: str, kept: str) -> Column:
    return F.expr(f"1 + (cast({SCALE} AS decimal(10,0)) * cast({count} + 1 AS decimal(20,0))) "
                  f"div cast({total} + {kept} AS decimal(20,0))")


def _price(p: str, q: str) -> Column:
    return F.expr(f"CASE WHEN {p} >= {q} THEN (({p} - {q}) * ({p} - {q})) div {q} "
                  f"ELSE (({q} - {p}) * ({q} - {p})) div {q} END")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, block_rows: int = BLOCK_ROWS,
          lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources, and each source's ``top`` terms."""
    spark = docs.sparkSession

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(path := scratch(spark, name))
        return spark.read.parquet(path)

    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
                         for c, to in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = stored(_counted(docs), "term-counts")
    blocks = max(1, -(-counted.count() // block_rows))
    # All sources of a term are in one block: one exchange serves the window and nothing of a term is collected.
    dealt = counted.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks))).repartition("lang", "block")
    term = Window.partitionBy("lang", "block", "term")
    kept = stored(
        dealt.withColumn("all_held", F.sum("held").over(term)).withColumn("all_n", F.sum("n").over(term))
        .withColumn("first", (F.min("source").over(term) == F.col("source")).cast("bigint"))
        .filter(F.col("all_held") >= least).select("lang", "source", "term", "n", "all_n", "first", "block"), "kept-terms")

    whole = kept.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("whole"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(
        docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(whole, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("total", "kept", "whole")]), "groups")

    shared = kept.select("lang", "source", "term", "n", "block").groupBy("lang", "block").applyInArrow(
        _products, "lang string, left string, a bigint, right string, b bigint, terms bigint")
    tables = stored(shared.groupBy("lang", "left", "a", "right", "b").agg(F.sum("terms").alias("terms")), "level-tables")

    side = lambda k: groups.select("lang", *[F.col(c).alias(f"{c}{k}") for c in ("source", "total", "kept")])
    pairs = side(1).join(side(2), "lang").filter("source1 <> source2")  # the result has a row for each of them

    def priced(rows: DataFrame, a: str, b: str, terms: str, value: Column) -> DataFrame:
        """Terms times a price made of p and q (at the two counts) and p0 and q0 (at none)."""
        rows = rows.filter("kept1 > 0").withColumn("p", _share(a, "total1", "kept1")).withColumn("q", _share(b, "total2", "kept2"))
        rows = rows.withColumn("p0", _share("0", "total1", "kept1")).withColumn("q0", _share("0", "total2", "kept2"))
        exact = F.expr(f"cast({terms} AS decimal(19,0))") * value.cast("decimal(19,0)")
        return rows.select("lang", "source1", "source2", exact.alias("value"))

    levels = tables.filter(F.col("left") == F.col("right")).select("lang", "left", "a", "terms")
    cells = tables.filter(F.col("left") != F.col("right"))
    joint = cells.selectExpr("lang", "left AS source1", "a", "right AS source2", "b", "terms").unionByName(
        cells.selectExpr("lang", "right AS source1", "b AS a", "left AS source2", "a AS b", "terms"))
    f00 = _price("p0", "q0")
    parts = [
        pairs.select("lang", "source1", "source2", F.lit(0).cast("decimal(38,0)").alias("value")),
        priced(pairs, "0", "0", "kept1", f00),
        priced(levels.withColumnRenamed("left", "source1").join(pairs, ["lang", "source1"]), "a", "0", "terms",
               _price("p", "q0") - f00),
        priced(levels.withColumnRenamed("left", "source2").join(pairs, ["lang", "source2"]), "0", "a", "terms",
               _price("p0", "q") - f00),
        priced(joint.join(side(1), ["lang", "source1"]).join(side(2), ["lang", "source2"]), "a", "b", "terms",
               _price("p", "q") - _price("p", "q0") - _price("p0", "q") + f00),
    ]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    by_pair = reduce(DataFrame.unionByName, parts).groupBy("lang", "source1", "source2").agg(
        F.sum("value").cast("bigint").alias("value")).select(
        "lang", F.col("source1").alias("source"), F.lit("pair").alias("part"), F.col("source2").alias("item"), "value"
    ).withColumn("rank", rank)
    by_term = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "kept")).withColumn("q", _share("all_n", "whole", "kept")) \
        .filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                _price("p", "q").alias("value")).withColumn("rank", rank).filter(F.col("rank") <= top)
    return by_pair.unionByName(by_term)
