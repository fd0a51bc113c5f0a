"""
Jaccard join of documents on five-word shingles, with Bayesian pruning.

1. Documents with equal shingle sets become one class of copies; the rest works on classes.
2. MinHash values in bands of four bring classes together that may be similar. A pair of similarity 0.8 shares
   none of the 32 bands with probability 5e-8. Buckets with equal members are searched once.
3. In a bucket, pairs are compared 16 MinHash values at a time and dropped as soon as the posterior
   probability (uniform prior) that they reach the threshold falls below ``TOLERANCE``.
4. What is left spans clusters; inside a cluster the shingle sets are intersected exactly, for all pairs.

Large buckets and clusters are cut into chunks, and each pair of chunks is a task of its own. Tasks return
a row per class, never rows per pair, so a group of thousands of near copies stays linear in
rows, while every link is counted.

Defined results: a text of one to four words is one shingle; a null or empty text is linked to nothing
and its own class; copies are linked to each other; repeated rows are copies; classes are compared by
128-bit digests of their sets; an empty table gives an empty result; other columns are neither
read nor returned.
"""

from __future__ import annotations

from fractions import Fraction
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import Words, mixed, slices
from plumbline.session import scratch

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
BAND = 4
STEP = 16
TOLERANCE = 1e-6
CHUNK = 256  # classes of a bucket compared at a time
VERIFY = 512  # classes of a cluster intersected at a time
COLUMNS = 8192  # shingles intersected at a time

_RNG = np.random.default_rng(20240717)
_TIMES = _RNG.integers(1, 1 << 32, HASHES, np.uint32) | np.uint32(1)
_FLIP = _RNG.integers(0, 1 << 32, HASHES, np.uint32)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of each row, sorted, end to end; and where each row's start."""
    words = Words.of(column)
    hashes = words.hashes()
    at = words.whole(size)
    value, row = words.grams(hashes, size)[at], words.row_of(at)
    for n in range(1, size):  # shorter texts are one shingle
        short = np.flatnonzero(words.counts == n)
        if len(short):
            value = np.concatenate([value, words.grams(hashes, n)[words.rows[short]] ^ np.uint64(n)])
            row = np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(column) + 1))


def signatures(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values (rows with at least one shingle only)."""
    small = (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((small ^ _FLIP[k]) * _TIMES[k], starts)
    return out


def _digests(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit digests of each row's shingle set."""
    n = np.diff(bounds)
    full = np.flatnonzero(n)
    d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(full):
        starts = bounds[:-1][full]
        d1[full] = np.add.reduceat(mixed(value), starts)
        d2[full] = np.add.reduceat(mixed(value ^ np.uint64(0x5851F42D4C957F2D)), starts)
    return n, d1, d2


def _classed(texts: DataFrame) -> DataFrame:
    """(n, d1, d2, text) of documents with a shingle, at least one for each set; a task sends each set once."""

    def digest(batches):
        sent: set[tuple] = set()
        for batch in slices(batches, "text"):
            n, d1, d2 = _digests(*shingle_sets(batch.column("text")))
            new = []
            for i, key in enumerate(zip(n.tolist(), d1.tolist(), d2.tolist())):
                if key[0] and key not in sent:
                    sent.add(key)
                    new.append(i)
            if new:
                at = np.array(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n[at].astype(np.int64)), pa.array(d1[at].view(np.int64)), pa.array(d2[at].view(np.int64)),
                     batch.column("text").take(pa.array(at))], ["n", "d1", "d2", "text"])

    return texts.select("text").mapInArrow(digest, "n bigint, d1 bigint, d2 bigint, text string")


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2, sig) of every document; sig is NULL without shingles."""

    def sketch(batches):
        for batch in slices(batches, "text"):
            value, bounds = shingle_sets(batch.column("text"))
            n, d1, d2 = _digests(value, bounds)
            full = np.flatnonzero(n)
            sig: list = [None] * len(n)
            if len(full):
                for i, row in zip(full, signatures(value, bounds[:-1][full])):
                    sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)),
                 pa.array(d2.view(np.int64)), pa.array(sig, pa.binary())], ["doc_id", "n", "d1", "d2", "sig"])

    return docs.mapInArrow(sketch, "doc_id bigint, n bigint, d1 bigint, d2 bigint, sig binary")


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared values, the fewest matches with which a pair stays."""
    out = []
    for n in range(HASHES + 1):
        total, m = 0.0, 0
        while m <= n:  # posterior that s >= t after m of n matches: P(Binomial(n + 1, t) <= m)
            total += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def surviving_pairs(a: np.ndarray, b: np.ndarray, least: list[int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that no comparison of further MinHash values has dropped."""
    matches = np.zeros((len(a), len(b)), np.int16)
    for k in range(STEP):
        matches += a[:, k, None] == b[None, :, k]
    alive = matches >= least[STEP]
    if same:
        alive &= np.tri(len(a), len(b), -1, bool)
    i, j = np.nonzero(alive)
    count = matches[i, j]
    for at in range(STEP, HASHES, STEP):
        if not len(i):
            break
        count = count + (a[i, at : at + STEP] == b[j, at : at + STEP]).sum(1)
        keep = count >= least[at + STEP]
        i, j, count = i[keep], j[keep], count[keep]
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row it is joined to by pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Which pairs reach the threshold, by exact intersections."""
    value = np.concatenate(sets_a + sets_b)
    row = np.repeat(np.arange(len(sets_a) + len(sets_b)), [len(s) for s in sets_a + sets_b])
    _, column, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets_a), len(sets_b)))
    for at in range(0, len(shared), COLUMNS):
        first, last = np.searchsorted(column, [at, at + COLUMNS])
        dense = np.zeros((len(sets_a) + len(sets_b), min(COLUMNS, len(shared) - at)), np.float32)
        dense[row[first:last], column[first:last] - at] = 1
        common += dense[: len(sets_a)] @ dense[len(sets_a) :].T
    size_a = np.array([len(s) for s in sets_a])[:, None]
    size_b = np.array([len(s) for s in sets_b])[None, :]
    common = common.astype(np.int64)
    return common * threshold.denominator >= (size_a + size_b - common) * threshold.numerator


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b): the smallest node each is joined to."""
    spark = edges.sparkSession

    def stored(frame):
        frame.write.parquet(path := scratch(spark, "components"))
        return spark.read.parquet(path)

    def state(frame):
        return tuple(frame.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    held = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = state(held)
    while known[0]:
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m")).select("_a", F.least("_a", "m").alias("m"))
        large = stored(both.filter("b > a").join(least, F.col("a") == F.col("_a")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        held = stored(small.filter("a <> b").unionByName(least.select(F.col("_a").alias("a"), F.col("m").alias("b"))).distinct())
        now = state(held)
        if now == known:
            break
        known = now
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _chunked(frame: DataFrame, group: str, size: str, chunk: int) -> DataFrame:
    """A row for each pair of chunks (i <= j) of its group that its own chunk ``c`` is part of."""
    many = F.ceil(F.col(size) / chunk)
    frame = frame.withColumn("c", F.pmod(F.xxhash64("k", group), many).cast("int")).withColumn(
        "_o", F.explode(F.sequence(F.lit(0), many.cast("int") - 1)))
    return frame.withColumns({"i": F.least("c", "_o"), "j": F.greatest("c", "_o")}).drop("_o")


def join(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text",
         tolerance: float = TOLERANCE) -> DataFrame:
    """
    (doc_id, class_id, copy_id, n_links) of every document.

    ``n_links`` counts the other documents at or above the threshold, ``class_id`` is the smallest
    doc_id reachable over links, ``copy_id`` that with an equal shingle set.
    """
    spark = docs.sparkSession
    exact = Fraction(threshold).limit_denominator(10_000)
    least = least_matches(threshold, tolerance)

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(path := scratch(spark, name))
        return spark.read.parquet(path)

    texts = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sketches = stored(_sketches(texts).withColumn("k", F.xxhash64("n", "d1", "d2")), "sketches")
    classes = stored(sketches.filter("n > 0").groupBy("k").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")), "classes")

    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 4 * BAND * b + 1, 4 * BAND)) for b in range(HASHES // BAND)])
    banded = classes.select("k", F.posexplode(keys).alias("band", "key"))
    buckets = banded.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("k")).alias("who"), F.first("band").alias("band"))
    # Buckets with the same members are one; the smallest key stands for them.
    chosen = buckets.filter("size > 1").groupBy("who", "size").agg(F.min("key").alias("_key"))
    members = banded.drop("band").join(chosen.drop("who"), F.col("key") == F.col("_key")).select("key", "size", "k")
    members = members.join(classes.select(F.col("k").alias("_k"), "sig"), F.col("k") == F.col("_k")).drop("_k")

    def prune(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        side = table.column("c").to_numpy()
        k = table.column("k").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(k), HASHES)
        first, second = np.flatnonzero(side == i), np.flatnonzero(side == j)
        a, b = surviving_pairs(sig[first], sig[second], least, i == j)
        root = k[_roots(len(k), first[a], second[b])]
        joined = root != k
        return pa.table({"a": pa.array(k[joined]), "b": pa.array(root[joined])})

    edges = _chunked(members, "key", "size", CHUNK).groupBy("key", "i", "j").applyInArrow(prune, "a bigint, b bigint")
    clusters = stored(components(edges), "clusters")
    sizes = clusters.groupBy(F.col("root").alias("_root")).agg(F.count(F.lit(1)).alias("size"))
    suspects = clusters.join(sizes, F.col("root") == F.col("_root")).select(
        F.col("node").alias("k"), F.col("root").alias("cluster"), "size")
    suspects = suspects.join(classes.select(F.col("k").alias("_k"), "copies"), F.col("k") == F.col("_k")).drop("_k")
    # One text for each class, found by the digest its rows are classed by: ids may repeat or be null.
    keyed = _classed(texts).withColumn("_k", F.xxhash64("n", "d1", "d2"))
    found = suspects.join(keyed, F.col("k") == F.col("_k")).groupBy("k").agg(
        *[F.first(c).alias(c) for c in ("cluster", "size", "copies", "text")])

    def sets(batches):
        for batch in slices(batches, "text"):
            value, bounds = shingle_sets(batch.column("text"))
            data = [value[bounds[r] : bounds[r + 1]].tobytes() for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("k", "cluster", "size", "copies")] + [pa.array(data, pa.binary())],
                ["k", "cluster", "size", "copies", "shingles"])

    members = found.mapInArrow(sets, "k bigint, cluster bigint, size bigint, copies bigint, shingles binary")

    def verify(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        k, side, copies = (table.column(c).to_numpy() for c in ("k", "c", "copies"))
        held = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        first, second = np.flatnonzero(side == i), np.flatnonzero(side == j)
        links = np.zeros(len(k), np.int64)
        root = np.arange(len(k))
        if len(first) and len(second):
            near = linked([held[r] for r in first], [held[r] for r in second], exact)
            if i == j:
                np.fill_diagonal(near, False)
            links[first] += near @ copies[second]
            if i != j:
                links[second] += near.T @ copies[first]
            a, b = np.nonzero(near)
            root = _roots(len(k), first[a], second[b])
        return pa.table({"k": pa.array(k), "links": pa.array(links), "root": pa.array(k[root])})

    checked = stored(_chunked(members, "cluster", "size", VERIFY).groupBy("cluster", "i", "j").applyInArrow(
        verify, "k bigint, links bigint, root bigint"), "links")
    groups = stored(components(checked.select(F.col("k").alias("a"), F.col("root").alias("b"))), "groups")
    reps = classes.select("k", "rep", "copies")
    least_rep = groups.join(reps, F.col("node") == F.col("k")).groupBy(F.col("root").alias("_root")).agg(
        F.min("rep").alias("class_id"))
    named = groups.join(least_rep, F.col("root") == F.col("_root")).select(F.col("node").alias("_n"), "class_id")
    counted = checked.groupBy(F.col("k").alias("_c")).agg(F.sum("links").alias("links"))
    table = reps.join(named, F.col("k") == F.col("_n"), "left").join(counted, F.col("k") == F.col("_c"), "left").select(
        F.col("k").alias("_k"), F.coalesce("class_id", "rep").alias("class_id"), F.col("rep").alias("copy_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = sketches.select("doc_id", F.when(F.col("n") > 0, F.col("k")).alias("k"))
    return rows.join(table, F.col("k") == F.col("_k"), "left").select(
        "doc_id", F.when(F.col("_k").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("_k").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
