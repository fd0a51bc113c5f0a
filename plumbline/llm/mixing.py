"""
Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; a flow then routes
the patterns' words to the sources' quotas, where taking a pattern's words a second or third time
costs more each time (convex costs spread repetition evenly). What a pattern sends decides how many
whole copies all of its documents get and how many words of one further copy; that copy goes to
documents in a seeded order, found from sums over small buckets of the order, so no source's documents
meet in one task. The last bucket is filled greedily, so the words taken come near the quota.

The driver sees one row per pattern, never documents.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own,
sorted last; repeated rows are taken each for itself; an empty table gives an empty result;
other columns are neither read nor returned.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a document
COSTS = (0, 1, 3)  # of the first, second and third copy
BUCKET_ROWS = 4096
SEED = 20240607
BROADCAST_PATTERNS = 100_000  # beyond, patterns are joined by shuffling


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Shares of all words by weight; what a source cannot give is shared out again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, out, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in names if s in open_ and weight[s] * unit > most * sizes[s]]
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= set(full)
        if not full:
            out |= {s: weight[s] * unit for s in open_}
            break
    return out


def route(patterns: dict[tuple, int], quotas: dict, costs=COSTS) -> dict[tuple, dict]:
    """
    The cheapest largest flow from patterns (words each) to source quotas: pattern -> source -> words.

    Patterns that share no source are solved apart from each other.
    """
    owner: dict = {}

    def find(s):
        while owner.setdefault(s, s) != s:
            owner[s] = s = owner[owner[s]]
        return s

    for p in patterns:
        for s in p[1:]:
            owner[find(s)] = find(p[0])
    groups = defaultdict(list)
    for p in patterns:
        groups[find(p[0])].append(p)
    out = {}
    for members in groups.values():
        out |= _flow({p: patterns[p] for p in members}, quotas, costs)
    return out


def _flow(patterns, quotas, costs):
    edges: list[list] = []  # to, room, cost
    links = defaultdict(list)

    def edge(a, b, room, cost):
        links[a].append(len(edges))
        edges.append([b, room, cost])
        links[b].append(len(edges))
        edges.append([a, 0, -cost])
        return len(edges) - 2

    ways = {}
    for p, words in patterns.items():
        for cost in costs:
            edge("from", ("p", p), words, cost)
        for s in p:
            ways[p, s] = edge(("p", p), ("s", s), words * len(costs), 0)
    for s in {s for p in patterns for s in p}:
        edge(("s", s), "to", round(quotas.get(s, 0)), 0)
    while True:
        cost, via, queue, queued = {"from": 0}, {}, deque(["from"]), {"from"}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in links[a]:
                b, room, c = edges[e]
                if room > 0 and cost[a] + c < cost.get(b, float("inf")):
                    cost[b], via[b] = cost[a] + c, e
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if "to" not in cost:
            break
        path, at = [], "to"
        while at != "from":
            path.append(via[at])
            at = edges[via[at] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    found = defaultdict(dict)
    for (p, s), e in ways.items():
        found[p][s] = edges[e ^ 1][1]
    return dict(found)


def nearest(sizes: np.ndarray, room: int, rounds: int = 20) -> np.ndarray:
    """Which of the sizes, in their order, to add up to about ``room``: greedily, then by exchanges."""
    chosen = np.zeros(len(sizes), bool)
    for k, words in enumerate(sizes.tolist()):
        if words <= room:
            chosen[k] = True
            room -= words
    for _ in range(rounds):
        out, own = np.flatnonzero(~chosen), np.flatnonzero(chosen)
        if not room:
            break
        out = out[np.argsort(sizes[out], kind="stable")]
        given = np.concatenate([[0], sizes[out]])  # in place of one, nothing may come too
        want = np.concatenate([[room], sizes[own] + room])
        at = np.searchsorted(given, want)
        near = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(given) - 1)])
        gap = np.abs(given[near] - want)
        side, k = np.unravel_index(np.argmin(gap), gap.shape)
        if gap[side, k] >= abs(room):
            break
        put, room = near[side, k], int(want[k] - given[near[side, k]])
        if put:
            chosen[out[put - 1]] = True
        if k:
            chosen[own[k - 1]] = False
    return chosen


def mix(sized: DataFrame, quotas: dict, seed: int = SEED, costs=COSTS, id: str = "doc_id",
        size: str = "size", sources: str = "sources") -> DataFrame:
    """
    How often each document is taken: its columns and ``taken`` (words, repeats counted).

    ``sources`` is an array of source names, a NULL among them being a name too; ``quotas`` has the
    words wanted of each source. The frame is read several times: pass one that is stored.
    """
    spark = sized.sparkSession
    pattern = F.to_json(F.struct(F.array_sort(F.array_distinct(F.col(sources))).alias("s")), {"ignoreNullFields": "false"})
    rows = sized.withColumns({
        "_p": pattern,
        "_h": F.xxhash64(F.col(id), F.lit(seed)),
    })
    # One row per membership pattern.
    known = rows.groupBy("_p").agg(
        F.first(F.array_sort(F.array_distinct(F.col(sources)))).alias("s"),
        F.sum(size).alias("words"), F.count(F.lit(1)).alias("n")).collect()
    keyed = {r._p: tuple(r.s) for r in known if r.s}
    flows = route({keyed[r._p]: r.words or 0 for r in known if r.s}, quotas, costs)
    plan = []
    for r in known:
        flow = sum(flows.get(keyed.get(r._p, ()), {}).values())
        whole = min(len(costs), flow // r.words) if r.words else 0
        plan.append((r._p, int(whole), int(flow - whole * (r.words or 0)), max(1, -(-r.n // BUCKET_ROWS))))
    # One row per pattern, already counted here; a large pattern then is not gathered by the join.
    small = F.broadcast if len(plan) <= BROADCAST_PATTERNS else (lambda frame: frame)
    plan = spark.createDataFrame(plan, "_q string, _whole long, _rest long, _buckets long")
    rows = rows.join(small(plan), F.col("_p") == F.col("_q")).drop("_q").withColumn(
        "_b", F.pmod(F.shiftrightunsigned("_h", 16), F.col("_buckets")))

    sums = rows.groupBy("_p", "_b", "_rest").agg(F.sum(size).alias("w"))
    sums.createOrReplaceTempView(view := f"mix_{scratch(spark, 'v')[-12:]}")
    edges = spark.sql(
        f"SELECT _p AS _q, _b AS _edge, _rest - before AS _room FROM (SELECT *, sum(w) OVER (PARTITION BY _p "
        f"ORDER BY _b) - w AS before FROM {view}) WHERE before <= _rest AND before + w > _rest")
    spark.catalog.dropTempView(view)
    # One row per pattern: the bucket in which its further copy ends, and the words left there.
    rows = rows.join(small(edges), F.col("_p") == F.col("_q"), "left").drop("_q")

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_h", "_size", "_id"], na_position="first")
        rows["_extra"] = nearest(rows["_size"].to_numpy(), int(rows["_room"].iloc[0])).astype("int32")
        return rows[["_h", "_id", "_size", "_extra"]]

    on_edge = rows.filter((F.col("_b") == F.col("_edge")) & (F.col(size) > 0))
    picked = (
        on_edge.select("_p", "_h", F.col(id).cast("string").alias("_id"), F.col(size).alias("_size"), "_room")
        .groupBy("_p").applyInPandas(greedy, "_h bigint, _id string, _size bigint, _extra int")
        .groupBy(F.col("_h").alias("_ph"), F.col("_id").alias("_pi"), F.col("_size").alias("_ps"))
        .agg(F.sum("_extra").alias("_chosen"))
    )
    # Rows that repeat in full share their picks: the first of them get one each.
    ranked = on_edge.withColumn("_i", F.expr(
        f"row_number() OVER (PARTITION BY _p, _h, cast({id} AS string), {size} ORDER BY _h)"))
    settled = ranked.join(picked, (F.col("_h") == F.col("_ph")) & F.col(id).cast("string").eqNullSafe(F.col("_pi"))
                          & (F.col(size) == F.col("_ps")), "left").withColumn(
        "_extra", (F.col("_i") <= F.coalesce("_chosen", F.lit(0))).cast("long"))
    others = rows.filter(~((F.col("_b") == F.col("_edge")) & (F.col(size) > 0)) | F.col("_edge").isNull()).withColumn(
        "_extra", F.coalesce((F.col("_b") < F.col("_edge")).cast("long"), (F.col("_rest") > 0).cast("long")))
    done = others.unionByName(settled.select(others.columns))
    return done.withColumn("taken", F.col(size) * (F.col("_whole") + F.col("_extra"))).select(*sized.columns, "taken")


def mix_sources(docs: DataFrame, weights=WEIGHTS, id: str = "doc_id", text: str = "text",
                source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Mix by one source column: sizes in words, shares of all words by weight."""
    spark = docs.sparkSession
    path = scratch(spark, "sizes")
    docs.select(
        F.col(id).alias("doc_id"), F.col(source).alias("source"), *keep,
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("sources", F.array("source")).write.parquet(path)
    sized = spark.read.parquet(path)
    # One row per source.
    totals = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    wanted = targets(totals, weights)
    about = spark.createDataFrame(
        [(s, int(totals[s]), float(wanted.get(s, 0.0))) for s in totals] or [], "_s string, source_size long, target double")
    taken = mix(sized, wanted)
    if len(totals) <= BROADCAST_PATTERNS:
        about = F.broadcast(about)
    return taken.join(about, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "sources")
