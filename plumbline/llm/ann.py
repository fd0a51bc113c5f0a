"""
Approximate nearest neighbours with learned partitions.

On a bounded sample of the vectors a neighbour graph is built and cut into balanced parts: a balanced
start by median splits, then moves that keep more neighbours together while no part outgrows its
share. A small classifier learns from each sampled vector where its neighbours lie. Every vector is
indexed in its most probable part; a query looks into its several most probable parts, and
what is found there is ranked by exact inner products in double precision. How many parts
that takes is measured on held-out sample rows against brute force, for ``RECALL``.

The sample has at most ``SAMPLE`` rows, chosen by row whatever their ids and vectors are. Parts are searched in blocks of rows by
chunks of queries, so a part, an id or a vector that holds a third of all rows is many tasks. Matrix products
only choose candidates, with a margin for their rounding; scores are sums in the order of the components, the same
wherever a pair is met, so equal vectors have equal scores.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; nor do those of
another length than most usable rows of the table have (of equally many, the shorter); equal scores go to the
smaller id, a null id last; a row without an id is a candidate; a repeated id is as many candidates (none of them its own query's)
and one query per row's distinct vector; an empty table gives an empty result; other columns are neither read nor
returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import scratch

SAMPLE = 8192
PARTS = 32
PART_ROWS = 64  # least sampled rows to a part
GRAPH = 10  # neighbours of each row in the graph
HIDDEN = 64
RECALL = 0.96  # wanted on held-out sample rows
HELD_OUT = 512
BLOCK = 4096
SEED = 11


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    return F.coalesce(
        F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(vector, lambda x: x != 0),
        F.lit(False))


def neighbours(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``x`` with the largest inner products to the rows numbered ``queries``, without themselves."""
    out = []
    for at in range(0, len(queries), 128):
        own = queries[at : at + 128]
        score = x[own] @ x.T
        score[np.arange(len(own)), own] = -np.inf
        out.append(np.argpartition(-score, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for every row: balanced, with few graph edges between parts."""
    label = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups.sort(key=len)
        largest = groups.pop()
        centred = x[largest] - x[largest].mean(0)
        axis = np.linalg.svd(centred[:2048], full_matrices=False)[2][0]
        order = largest[np.argsort(centred @ axis, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for k, rows in enumerate(groups):
        label[rows] = k
    most = int(np.ceil(slack * len(x) / parts))
    fill = np.bincount(label, minlength=parts)
    edges = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()]),
                            np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])], 1)
    for _ in range(rounds):
        near = np.bincount(edges[0] * parts + label[edges[1]], minlength=len(x) * parts).reshape(-1, parts)
        best = near.argmax(1)
        gain = near[np.arange(len(x)), best] - near[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if fill[best[i]] < most:
                fill[label[i]] -= 1
                fill[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A classifier with one hidden layer: how probable it is that a vector's neighbours lie in each part."""

    def __init__(self, x: np.ndarray, target: np.ndarray, epochs: int = 40):
        rng = np.random.default_rng(SEED)
        self.scale = np.float32(1 / max(float(np.sqrt((x**2).sum(1).mean())), 1e-30) * 8)
        d, p = x.shape[1], target.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, p)), np.zeros(p)]
        x = x * self.scale
        mean, square, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                hidden, out = self._forward(x[rows])
                d_out = (out - target[rows]) / len(rows)
                d_hidden = (d_out @ self.w[2].T) * (hidden > 0)
                step += 1
                for k, grad in enumerate((x[rows].T @ d_hidden, d_hidden.sum(0), hidden.T @ d_out, d_out.sum(0))):
                    mean[k] = 0.9 * mean[k] + 0.1 * grad
                    square[k] = 0.999 * square[k] + 0.001 * grad**2
                    self.w[k] -= 0.003 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)

    def _forward(self, x):
        hidden = np.maximum(x @ self.w[0] + self.w[1], 0)
        out = hidden @ self.w[2] + self.w[3]
        out = np.exp(out - out.max(1, keepdims=True))
        return hidden, out / out.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x * self.scale)[1]


class Index:
    """The router, and how many parts a query looks into."""

    def __init__(self, x: np.ndarray, k: int, parts: int = PARTS, recall: float = RECALL):
        self.parts = max(1, min(parts, len(x) // PART_ROWS))
        everyone = np.arange(len(x))
        graph = neighbours(x, everyone, min(GRAPH, len(x) - 1)) if len(x) > 1 else np.zeros((len(x), 0), np.int64)
        label = balanced_parts(x, graph, self.parts)
        target = np.eye(self.parts)[np.concatenate([label[:, None], label[graph]], 1)].mean(1)
        held = np.random.default_rng(SEED).permutation(len(x))[: min(HELD_OUT, len(x) // 4)]
        learn = np.setdiff1d(everyone, held)
        self.router = Router(x[learn], target[learn])
        self.probes, self.measured = self.parts, 1.0
        if self.parts > 1:
            chance = self.router(x)
            part = chance.argmax(1)
            order = np.argsort(-chance[held], 1, kind="stable")
            wanted = part[neighbours(x, held, min(k, len(x) - 1))]
            place = np.argsort(order, 1)[np.arange(len(held))[:, None], wanted]
            reached = np.array([(place < m).mean() for m in range(1, self.parts + 1)])
            self.probes = int(np.argmax(reached >= recall)) + 1
            self.measured = float(reached[self.probes - 1])

    def ranked_parts(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.router(x), 1, kind="stable")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def fit(rows: DataFrame, k: int, sample: int = SAMPLE, **settings) -> Index | None:
    """An index from at most ``sample`` (id, vector) rows of one length; None if there are none."""
    total = rows.count()
    rows = rows.withColumn("order", F.xxhash64("id", "vector", F.monotonically_increasing_id(), F.lit(SEED)))
    if total > sample:  # about twice as many as wanted reach the driver, which keeps the first
        rows = rows.filter(F.pmod("order", F.lit(1 << 30)) < int(min(1.0, 2 * sample / total) * (1 << 30)))
    vectors = rows.orderBy("order").limit(sample).select("vector").toArrow().column("vector")
    return Index(_matrix(vectors), k, **settings) if len(vectors) else None


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed in the order of the components."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


def search(vectors: DataFrame, queries: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding",
           block: int = BLOCK, **settings) -> DataFrame:
    """
    (query_id, rank, vec_id, score): the ``k`` nearest found of each row for which ``queries`` holds.

    Rows that repeat an id and its vector are one query; an id with several vectors has a ranking for each.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("vector"),
                          F.coalesce(queries & F.col(id).isNotNull(), F.lit(False)).alias("asks")).filter(usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()  # one row
    rows = rows.filter(F.size("vector") == (common["length"] if common else 0))
    index = fit(rows, k, **settings)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shared = spark.sparkContext.broadcast(index)  # the weights of one small layer

    def route(batches):
        known = shared.value
        for batch in batches:
            if batch.num_rows:
                found = known.ranked_parts(_matrix(batch.column("vector")))[:, : known.probes].astype(np.int32)
                asks = batch.column("asks").to_numpy(zero_copy_only=False)
                parts = [p.tolist() if a else p[:1].tolist() for p, a in zip(found, asks)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("vector"), batch.column("asks"), pa.array(parts, pa.list_(pa.int32()))],
                    ["id", "vector", "asks", "parts"])

    kind = rows.schema["vector"].dataType.simpleString()
    rows.mapInArrow(route, f"id bigint, vector {kind}, asks boolean, parts array<int>").withColumn(
        "row", F.monotonically_increasing_id()).write.parquet(path := scratch(spark, "vectors"))
    routed = spark.read.parquet(path)
    # Equal vectors have equal parts. The number of a query has to be the same in every pass.
    routed.filter("asks").groupBy("id", "vector").agg(F.first("parts").alias("parts")).withColumn(
        "query", F.monotonically_increasing_id()).write.parquet(asking := scratch(spark, "queries"))
    asking = spark.read.parquet(asking)
    # One row per part: how many blocks of rows and chunks of queries it is searched in.
    held = routed.select(F.col("parts")[0].alias("part"), F.lit(1).alias("rows"), F.lit(0).alias("asked"))
    asked = asking.select(F.explode("parts").alias("part"), F.lit(0).alias("rows"), F.lit(1).alias("asked"))
    size = held.unionByName(asked).groupBy("part").agg(
        F.ceil(F.sum("rows") / block).alias("blocks"), F.ceil(F.sum("asked") / block).alias("chunks"))
    size.write.parquet(sizes := scratch(spark, "part-sizes"))
    size = lambda: F.broadcast(spark.read.parquet(sizes).withColumnRenamed("part", "_part"))
    base = routed.select("id", "vector", "row", F.col("parts")[0].alias("part")).join(size(), F.col("part") == F.col("_part")).select(
        "id", "vector", "part", F.pmod(F.xxhash64("row", F.lit(1)), "blocks").alias("block"),
        F.explode(F.sequence(F.lit(1), F.greatest("chunks", F.lit(1)))).alias("chunk"))
    ask = asking.select("query", "id", "vector", F.explode("parts").alias("part")).join(
        size(), F.col("part") == F.col("_part")).filter("blocks > 0").select(
        "query", "id", "vector", "part", (F.pmod(F.xxhash64("query", F.lit(2)), "chunks") + 1).alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    keys = ["part", "block", "chunk"]

    def rank(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = ([], [], [], [], [])
        if asked.num_rows and held.num_rows:
            named = held.column("id").is_valid().to_numpy()
            ids, x = held.column("id").fill_null(0).to_numpy(), _matrix(held.column("vector"))
            asks, q = asked.column("id").to_numpy(), _matrix(asked.column("vector"))
            number = asked.column("query").to_numpy()
            rounding = 4 * x.shape[1] * np.finfo(float).eps * np.sqrt((x**2).sum(1).max())
            for at in range(0, len(asks), 256):
                own = q[at : at + 256]
                score = own @ x.T
                score[(asks[at : at + 256, None] == ids[None, :]) & named[None, :]] = -np.inf
                margin = rounding * np.sqrt((own**2).sum(1))
                chosen = []
                for i, line in enumerate(score):
                    least = np.partition(line, -k)[-k] - margin[i] if len(line) > k else -np.inf
                    chosen.append(np.flatnonzero((line >= least) & (line > -np.inf)))
                row, near = np.repeat(np.arange(len(own)), list(map(len, chosen))), np.concatenate(chosen)
                exact = _products(own[row], x[near])
                order = np.lexsort((ids[near], ~named[near], -exact, row))
                first = np.searchsorted(row, row)  # rows are in order before and after
                order = order[np.arange(len(row)) - first < k]
                row, near = row[order], near[order]
                found[0].append(asks[at + row])
                found[1].append(np.where(named[near], ids[near], 0))
                found[2].append(exact[order])
                found[3].append(number[at + row])
                found[4].append(~named[near])
        parts = [np.concatenate(f) if f else np.zeros(0) for f in found]
        return pa.table({"query_id": pa.array(parts[0].astype(np.int64)),
                         "vec_id": pa.array(parts[1].astype(np.int64), mask=parts[4].astype(bool)),
                         "score": pa.array(parts[2].astype(np.float64)), "query": pa.array(parts[3].astype(np.int64))})

    found = ask.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInArrow(
        rank, "query_id bigint, vec_id bigint, score double, query bigint")
    found.createOrReplaceTempView(view := f"near_{scratch(spark, 'v')[-12:]}")
    ranked = spark.sql(
        f"SELECT query_id, cast(rank AS int) AS rank, vec_id, score FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM {view}) WHERE rank <= {int(k)}")
    spark.catalog.dropTempView(view)
    return ranked
