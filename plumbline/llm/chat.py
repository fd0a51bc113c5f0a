"""
Reply trees formatted as chat.

Messages with a parent form trees. Iterative self-joins with doubling steps enumerate every path from
a leaf to its root (rounds grow with the logarithm of the depth), branches are ranked by the sum of
their scores, and each chosen path becomes one conversation: a string in which control strings mark
the turns, and the spans of the assistant's texts for the loss. Control strings inside roles and
texts are escaped with a backslash, so the string can be read back in full.

All of it is DataFrame code. A conversation becomes one row, as its string has to.

Defined results: a null text or role is empty; a message whose parent is unknown is a root; messages
on a cycle have no root and are on no path; equal scores are ranked by the smallest leaf; repeated
(tree, node) pairs are not allowed in ``best_paths``, while ``threads`` numbers the rows of a
conversation, so repeated turns are all kept, in the order of their role and text; an empty table
gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import scratch

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """The text without any ``<|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _stored(frame: DataFrame) -> DataFrame:
    frame.write.parquet(path := scratch(frame.sparkSession, "reply-tree"))
    return frame.sparkSession.read.parquet(path)


def threads(messages: DataFrame, tree: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: (tree, node, parent, role, text), numbered by ``order``."""
    rows = messages.select(
        F.col(tree).alias("tree"), F.col(order).alias("_o"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows.createOrReplaceTempView(view := f"threads_{scratch(rows.sparkSession, 'v')[-12:]}")
    numbered = rows.sparkSession.sql(
        f"SELECT tree, cast(row_number() OVER (PARTITION BY tree ORDER BY _o, role, text) AS bigint) AS node, "
        f"role, text FROM {view}")
    rows.sparkSession.catalog.dropTempView(view)
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def best_paths(messages: DataFrame, score: str | None = None, branches: int = 1) -> DataFrame:
    """
    (tree, leaf, rank, place, node): the nodes of each tree's best ``branches``, root at place 0.
    """
    points = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    nodes = _stored(messages.select("tree", "node", "parent", points.alias("points")))
    named = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    same = F.col("tree").eqNullSafe(F.col("_t"))
    jumps = _stored(nodes.join(named, same & (F.col("parent") == F.col("_n")), "left")
                    .select("tree", "node", F.col("_n").alias("up")))
    inner = jumps.filter("up IS NOT NULL").select(F.col("tree").alias("_t"), F.col("up").alias("_n")).distinct()
    members = nodes.join(inner, same & (F.col("node") == F.col("_n")), "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("above"))
    roots = jumps.filter("up IS NULL").select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    deepest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0  # bounds the rounds on cycles
    step = 1
    while step < deepest and not jumps.filter("up IS NOT NULL").isEmpty():
        hop = jumps.filter("up IS NOT NULL").select(
            F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_u"))
        further = members.join(hop, same & (F.col("node") == F.col("_n"))).select(
            "tree", "leaf", F.col("_u").alias("node"), (F.col("above") + step).alias("above"))
        members = _stored(members.unionByName(further))
        jumps = _stored(jumps.filter("up IS NOT NULL").join(
            hop, same & (F.col("up") == F.col("_n")), "left").select("tree", "node", F.col("_u").alias("up")))
        step *= 2
    rooted = members.join(roots, same & (F.col("node") == F.col("_n"))).select(
        F.col("tree").alias("_t"), F.col("leaf").alias("_l"))
    members = _stored(members.join(rooted, same & (F.col("leaf") == F.col("_l")), "left_semi"))
    points = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "points")
    sums = members.join(points, same & (F.col("node") == F.col("_n"))).groupBy("tree", "leaf").agg(
        F.sum("points").alias("total"), F.max("above").alias("depth"))
    sums.createOrReplaceTempView(view := f"paths_{scratch(sums.sparkSession, 'v')[-12:]}")
    chosen = sums.sparkSession.sql(
        f"SELECT tree AS _t, leaf AS _l, depth, rank FROM (SELECT *, row_number() OVER (PARTITION BY tree "
        f"ORDER BY total DESC, leaf) AS rank FROM {view}) WHERE rank <= {int(branches)}")
    sums.sparkSession.catalog.dropTempView(view)
    return members.join(chosen, same & (F.col("leaf") == F.col("_l"))).select(
        "tree", "leaf", "rank", (F.col("depth") - F.col("above")).alias("place"), "node")


def formatted(messages: DataFrame, paths: DataFrame, trained: str = TRAINED) -> DataFrame:
    """
    One row per path: (tree, leaf, rank, formatted, loss), ``loss`` being spans (start, length) in
    code points of the formatted string, one for each text of the ``trained`` role.
    """
    body = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text")
    turns = paths.join(body, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    turns = turns.select(
        "tree", "leaf", "rank", "place",
        F.concat(F.lit(START), role, F.lit(MIDDLE), text, F.lit(END)).alias("turn"),
        F.when(F.col("role") == trained, F.length(text)).alias("own"),
        (F.length(role) + len(START) + len(MIDDLE)).alias("before"),
    )
    rows = turns.groupBy("tree", "leaf", "rank").agg(
        F.sort_array(F.collect_list(F.struct("place", "turn", "own", "before"))).alias("turns"))
    return rows.select(
        "tree", "leaf", "rank",
        F.concat_ws("", F.col("turns.turn")).alias("formatted"),
        F.expr("""filter(aggregate(turns,
            named_struct('at', 0, 'spans', cast(array() AS array<struct<start:int,length:int>>)),
            (a, t) -> named_struct(
                'at', a.at + length(t.turn),
                'spans', concat(a.spans, array(named_struct('start', a.at + t.before, 'length', t.own))))
            ).spans, s -> s.length IS NOT NULL)""").alias("loss"),
    )


def read_back(rows: DataFrame) -> DataFrame:
    """The turns and the trained text of formatted conversations, from their strings alone."""
    parts = F.slice(F.split("formatted", r"<\|im_end\|>", -1), 1, F.size(F.split("formatted", r"<\|im_end\|>", -1)) - 1)
    return rows.withColumn(
        "turns", F.transform(parts, lambda t: F.struct(
            unescaped(F.substring_index(F.substr(t, F.lit(len(START) + 1)), MIDDLE, 1)).alias("role"),
            unescaped(F.substring_index(t, MIDDLE, -1)).alias("text")))
    ).withColumn(
        "loss_text", F.concat_ws("", F.transform("loss", lambda s: unescaped(
            F.substr(F.col("formatted"), s["start"] + 1, s["length"]))))
    )
