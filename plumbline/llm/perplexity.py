"""
Quality rules with n-gram perplexity.

A modified Kneser-Ney model over UTF-8 bytes is counted by Spark for each language, over every byte
of every document. Its entries are kept as sorted arrays of integer keys (language, order, bytes), in
which a document's n-grams are looked up by binary search. A document whose perplexity lies
outside its language's band is rejected. The band comes from the histogram of all documents
that pass the base rules, copies counting once: quartiles widened by multiples of their distance, ``SPREAD``.

Bytes instead of words keep the number of distinct n-grams small against the text, so that counting
moves far less than the corpus; the counts still come from all of it. The model is broadcast only up
to ``BROADCAST_ENTRIES``; beyond that, the same scores are computed by joins. Log probabilities are whole
numbers of 2^-24, so that their sums are exact: a text's score is the same on both paths, in any
order and in any split of the table.

Defined results: a null or empty text has no words, fails the base rules and has a NULL perplexity; a
null language is a language of its own; repeated rows count and are returned as often as they
come; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import Words, mixed, slices, text_bytes
from plumbline.session import scratch

ORDER = 5
SPREAD = (3.0, 2.0)  # below and above; the README has what each rejects of poor and good documents
MIN_WORDS = 50
BROADCAST_ENTRIES = 4_000_000  # about 40 bytes each while they are gathered
SLICE_BYTES = 2 << 20  # of text; about 100 bytes of arrays for each
STEP = 1 << 24  # log probabilities are counted in steps of 1 / STEP and kept in 32 bits, so down to -128
LOWEST = -(1 << 31) + 1
UNKNOWN = 1  # in place of a log probability: an n-gram that is only a context
UNSEEN = round(-float(np.log(256)) * STEP)
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def base_measures(batch: pa.RecordBatch, column: str) -> dict[str, np.ndarray]:
    """Word, symbol, repeated-line and repeated-3-word measures of each row."""
    text = batch.column(column)
    words = Words.of(text)
    raw, offsets = text_bytes(text)
    hashes = words.hashes()
    n = words.counts

    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    inside = points[words.ends] - points[words.starts]
    word_chars = np.concatenate([[0], np.cumsum(inside)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])

    return {
        "n_words": n,
        "word_chars": word_chars[words.rows[1:]] - word_chars[words.rows[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": _repeated_lines(raw, offsets, words),
        "n_repeat_words": _repeated_words(words, hashes),
    }


def _repeated_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Words inside a 3-word window that the same text holds twice or more."""
    at = words.whole(3)
    if not len(at):
        return np.zeros(len(words.rows) - 1, np.int64)
    row = words.row_of(at)
    key = mixed(words.grams(hashes, 3)[at] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[times[back] > 1]
    covered = np.zeros(len(hashes) + 3, bool)
    for k in range(3):
        covered[hit + k] = True
    total = np.concatenate([[0], np.cumsum(covered[: len(hashes)])])
    return total[words.rows[1:]] - total[words.rows[:-1]]


def _repeated_lines(raw: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text, byte for byte."""
    out = np.zeros(len(offsets) - 1, np.int64)
    breaks = np.flatnonzero(raw == 10)
    per_row = np.searchsorted(breaks, offsets)
    data = raw.tobytes()
    for i in np.flatnonzero(np.diff(per_row) > 0):
        seen: set[bytes] = set()
        for line in data[offsets[i] : offsets[i + 1]].split(b"\n"):
            if line.strip(b" \t\n\r\x0b\x0c"):
                if line in seen:
                    out[i] += 1
                else:
                    seen.add(line)
    return out


def byte_grams(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte, it and the ``order`` - 1 before it as one integer; 0 before a text's start."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[8:] = raw
    # Eight bytes up to and with each byte, read as one big-endian number.
    last = np.ndarray((len(raw),), ">u8", padded, offset=1, strides=(1,)).astype(np.uint64)
    out = last & np.uint64((1 << (8 * order)) - 1)
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    for k in range(order - 1):  # what reaches back into the text before is cut off
        at = filled + k
        at = at[at < np.append(filled[1:], len(raw))]
        out[at] &= np.uint64((1 << (8 * (k + 1))) - 1)
    return out


def count_grams(docs: DataFrame, order: int = ORDER, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, code, n): how often each byte n-gram occurs in all texts of a language."""

    def partial(batches):
        held: dict[str | None, list] = {}
        size = 0

        def emit():
            for key, parts in held.items():
                codes, counts = _merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * 1, pa.string()).take(pa.array(np.zeros(len(codes), np.int32))),
                     pa.array(codes.astype(np.int64)), pa.array(counts)], ["lang", "code", "n"])

        for batch in slices(batches, "text", SLICE_BYTES):
            langs = batch.column("lang").dictionary_encode()
            raw, offsets = text_bytes(batch.column("text"))
            codes = byte_grams(raw, offsets, order)
            index = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            owner = np.repeat(index, np.diff(offsets))
            for i in np.unique(index):
                key = None if i < 0 else langs.dictionary[int(i)].as_py()
                parts = held.setdefault(key, [])
                parts.append(np.unique(codes[owner == i], return_counts=True))
                size += len(parts[-1][0])
                if len(parts) >= 8:
                    merged = _merged(parts)
                    size += len(merged[0]) - sum(len(c) for c, _ in parts)
                    held[key] = [merged]
            if size > 2_000_000:  # bounds a worker's memory; Spark adds up what was sent
                yield from emit()
                held, size = {}, 0
        yield from emit()

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.length("text") > 0)
    parts = rows.mapInArrow(partial, "lang string, code bigint, n bigint")
    return parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes = np.concatenate([c for c, _ in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """
    (lang, ord, code, logp, backoff) of every n-gram of every order, natural logarithms in steps of 1 / ``STEP``.

    Below the highest order an n-gram counts by how many different bytes precede it. Three discounts
    per language and order follow from the counts of counts; where those are too
    few for the usual formula, 0.5, 1 and 1.5 stand in.
    """
    spark = counts.sparkSession

    def stored(frame: DataFrame) -> DataFrame:
        # Each step is read by several later ones: stored, it runs once and plans stay small.
        frame.write.parquet(path := scratch(spark, "kneser-ney-step"))
        return spark.read.parquet(path)

    levels = {order: counts.select("lang", "code", "n")}
    for k in range(order - 1, 0, -1):
        low = F.col("code").bitwiseAND(F.lit((1 << (8 * k)) - 1))
        levels[k] = stored(
            levels[k + 1].groupBy("lang", low.alias("code")).agg(F.count(F.lit(1)).alias("n")))

    def steps(p: Column) -> Column:
        return F.greatest(F.round(F.log(p) * STEP), F.lit(LOWEST)).cast("long")

    model, lower = None, None
    for k in range(1, order + 1):
        rows = levels[k].withColumn("context", F.shiftrightunsigned("code", 8))
        seen = [F.count_if(F.col("n") == i).cast("double") for i in (1, 2, 3, 4)]
        y = seen[0] / F.nullif(seen[0] + 2 * seen[1], F.lit(0.0))

        def discount(i: int, default: float) -> Column:
            found = i - (i + 1) * y * seen[i] / F.nullif(seen[i - 1], F.lit(0.0))
            # Of few binary digits, so that adding them up is exact in any order.
            return F.when(found.between(0.01, i), F.round(found * (1 << 20)) / (1 << 20)).otherwise(F.lit(default))

        discounts = rows.groupBy("lang").agg(
            *[discount(i, i / 2).alias(f"d{i}") for i in (1, 2, 3)]
        )
        # One row per language.
        rows = rows.withColumn("tier", F.least("n", F.lit(3))).join(
            discounts.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang"))
        ).drop("_lang")
        rows = rows.withColumn(
            "off", F.when(F.col("tier") == 1, F.col("d1")).when(F.col("tier") == 2, F.col("d2")).otherwise(F.col("d3"))
        )
        totals = stored(rows.groupBy(F.col("lang").alias("_lang"), F.col("context").alias("_context")).agg(
            F.sum("n").alias("total"), F.sum("off").alias("freed")
        ))
        rows = rows.join(
            totals, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("context") == F.col("_context"))
        ).drop("_lang", "_context")
        own = (F.col("n") - F.col("off")) / F.col("total")
        spread = F.col("freed") / F.col("total")
        if lower is None:
            rows = rows.withColumn("p", own + spread / F.lit(256.0))
        else:
            below = lower.select(
                F.col("lang").alias("_lang"), F.col("code").alias("_code"), F.col("p").alias("below")
            )
            low = F.col("code").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))
            rows = rows.join(
                below, F.col("lang").eqNullSafe(F.col("_lang")) & (low == F.col("_code"))
            ).withColumn("p", own + spread * F.col("below"))
        rows = stored(rows.select("lang", "code", "p"))
        backoff = totals.select(
            F.col("_lang").alias("lang"), F.lit(k - 1).alias("ord"), F.col("_context").alias("code"),
            F.lit(None).cast("long").alias("logp"),
            steps(F.col("freed") / F.col("total")).alias("backoff"),
        )
        lower = rows
        entry = rows.select(
            "lang", F.lit(k).alias("ord"), "code", steps(F.col("p")).alias("logp"),
            F.lit(None).cast("long").alias("backoff"),
        )
        both = entry.unionByName(backoff)
        model = both if model is None else model.unionByName(both)
    return model.groupBy("lang", "ord", "code").agg(
        F.max("logp").alias("logp"), F.coalesce(F.max("backoff"), F.lit(0)).alias("backoff")
    )


class SortedModel:
    """A model as sorted arrays, for binary search."""

    def __init__(self, table: pa.Table, order: int):
        self.order = order
        langs = table.column("lang").combine_chunks()
        ords = table.column("ord").to_numpy()
        codes = table.column("code").to_numpy().astype(np.uint64)
        logp = table.column("logp").fill_null(UNKNOWN).to_numpy().astype(np.int32)
        backoff = table.column("backoff").to_numpy().astype(np.int32)
        encoded = langs.dictionary_encode()
        encoded = encoded if isinstance(encoded, pa.DictionaryArray) else encoded.combine_chunks()
        index = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.parts = {}
        for i in np.unique(index):
            lang = None if i < 0 else encoded.dictionary[int(i)].as_py()
            for k in range(order + 1):
                mine = np.flatnonzero((index == i) & (ords == k))
                mine = mine[np.argsort(codes[mine])]
                self.parts[lang, k] = (codes[mine], logp[mine], backoff[mine])

    def _find(self, lang, k, wanted):
        codes, logp, backoff = self.parts.get((lang, k), (np.zeros(0, np.uint64), *[np.zeros(0, np.int32)] * 2))
        if not len(codes):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64), logp, backoff
        at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        return codes[at] == wanted, at, logp, backoff

    def log_probabilities(self, lang, codes: np.ndarray) -> np.ndarray:
        return self.steps(lang, codes) / STEP

    def steps(self, lang, codes: np.ndarray) -> np.ndarray:
        """Log probabilities as whole numbers of 1 / ``STEP``."""
        codes, back = np.unique(codes, return_inverse=True)
        return self._of_different(lang, codes)[back]

    def _of_different(self, lang, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), np.int64)
        todo = np.arange(len(codes))
        for k in range(self.order, 0, -1):
            wanted = codes[todo] & np.uint64((1 << (8 * k)) - 1)
            hit, at, logp, _ = self._find(lang, k, wanted)
            known = hit & (logp[at] != UNKNOWN) if len(logp) else hit
            out[todo[known]] += logp[at[known]]
            todo, wanted = todo[~known], wanted[~known]
            if not len(todo):
                return out
            seen, at, _, backoff = self._find(lang, k - 1, wanted >> np.uint64(8))
            out[todo[seen]] += backoff[at[seen]]
        out[todo] += UNSEEN
        return out


def measures(docs: DataFrame, model: DataFrame, order: int = ORDER, id: str = "doc_id",
             text: str = "text", lang: str = "lang", entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """One row per document: base measures, bytes, the total log probability of its bytes, a digest of its text."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(lang).alias("lang"), F.xxhash64(text).alias("digest"),
                       F.col(text).alias("text"))
    measured = ("doc_id bigint, lang string, digest bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
                "n_dup_lines bigint, n_repeat_words bigint, n_bytes bigint, loglik double")
    small = model.count() <= entries
    if not small:  # the joins need a key of each row, the same in both passes: ids may repeat or be null
        rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(
            path := scratch(docs.sparkSession, "keyed-documents"))
        rows, measured = docs.sparkSession.read.parquet(path), f"row bigint, {measured}"
    table = SortedModel(model.toArrow(), order) if small else None
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def measure(batches):
        known = shared.value
        for batch in slices(batches, "text", SLICE_BYTES):
            raw, offsets = text_bytes(batch.column("text"))
            loglik = np.zeros(batch.num_rows, np.int64)
            if known is not None:
                codes = byte_grams(raw, offsets, order)
                langs = batch.column("lang").dictionary_encode()
                index = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                owner = np.repeat(index, np.diff(offsets))
                each = np.zeros(len(raw), np.int64)
                for i in np.unique(index):
                    key = None if i < 0 else langs.dictionary[int(i)].as_py()
                    mine = owner == i
                    each[mine] = known.steps(key, codes[mine])
                running = np.concatenate([[0], np.cumsum(each)])
                loglik = running[offsets[1:]] - running[offsets[:-1]]
            found = base_measures(batch, "text")
            own = [c for c in ("row", "doc_id", "lang", "digest") if c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in own],
                 *[pa.array(v.astype(np.int64)) for v in found.values()],
                 pa.array(np.diff(offsets)), pa.array(loglik / STEP)],
                [*own, *found, "n_bytes", "loglik"])

    out = rows.mapInArrow(measure, measured)
    if small:
        return out
    return _joined_scores(out, rows, model, order)


def _joined_scores(measured: DataFrame, rows: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """Log probabilities by joins, for a model too large to send to every worker."""

    def grams(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            raw, offsets = text_bytes(batch.column("text"))
            codes = byte_grams(raw, offsets, order)
            for i in range(batch.num_rows):
                mine, n = np.unique(codes[offsets[i] : offsets[i + 1]], return_counts=True)
                if len(mine):
                    row = pa.array(np.zeros(len(mine), np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row").slice(i, 1).take(row), batch.column("lang").slice(i, 1).take(row),
                         pa.array(mine.astype(np.int64)), pa.array(n.astype(np.int64))], ["row", "lang", "code", "n"])

    todo = rows.mapInArrow(grams, "row bigint, lang string, code bigint, n bigint").withColumn(
        "owed", F.lit(0).cast("long")
    )
    done = None
    for k in range(order, 0, -1):
        known = model.filter((F.col("ord") == k) & F.col("logp").isNotNull()).select(
            F.col("lang").alias("_l"), F.col("code").alias("_c"), "logp")
        steps = model.filter(F.col("ord") == k - 1).select(
            F.col("lang").alias("_m"), F.col("code").alias("_x"), "backoff")
        todo = todo.withColumn("code", F.col("code").bitwiseAND(F.lit((1 << (8 * k)) - 1)))
        found = todo.join(known, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("code") == F.col("_c")), "left")
        part = found.filter(F.col("logp").isNotNull()).select(
            "row", (F.col("n") * (F.col("logp") + F.col("owed"))).alias("loglik"))
        done = part if done is None else done.unionByName(part)
        todo = found.filter(F.col("logp").isNull()).join(
            steps,
            F.col("lang").eqNullSafe(F.col("_m")) & (F.shiftrightunsigned("code", 8) == F.col("_x")), "left",
        ).select("row", "lang", "code", "n", (F.col("owed") + F.coalesce("backoff", F.lit(0))).alias("owed"))
    rest = todo.select("row", (F.col("n") * (F.col("owed") + F.lit(UNSEEN))).alias("loglik"))
    scores = done.unionByName(rest).groupBy(F.col("row").alias("_r")).agg(
        (F.sum("loglik").cast("double") / STEP).alias("loglik"))
    return measured.drop("loglik").join(scores, F.col("row") == F.col("_r"), "left").drop("row", "_r").withColumn(
        "loglik", F.coalesce("loglik", F.lit(0.0)))


def bands(scored: DataFrame, spread: tuple[float, float] = SPREAD,
          copies: tuple[str, ...] = ("n_bytes", "n_words", "word_chars", "bits")) -> DataFrame:
    """
    (lang, low, high): limits of the bits per byte, from a histogram in steps of 1/256 bit.

    Rows of a language that agree in the columns ``copies`` count once.
    """
    once = scored.filter(~F.col("base_failed") & F.col("bits").isNotNull()).groupBy(
        "lang", *copies).agg(F.min("bits").alias("least"))
    step = once.groupBy(
        "lang", F.floor(F.col("least") * 256).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # At most 256 times the largest bits per byte rows for each language.
    gathered = step.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))
    upto = F.transform("bins", lambda b, i: F.struct(
        b["bin"].alias("bin"),
        F.aggregate(F.slice("bins", 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("upto")))
    quartile = lambda q: F.get(F.filter("upto", lambda b: b["upto"] >= F.col("total") * q), F.lit(0))["bin"] / 256
    found = gathered.withColumn("upto", upto).select(
        "lang", quartile(0.25).alias("q1"), quartile(0.5).alias("q2"), quartile(0.75).alias("q3"))
    width = F.greatest(F.col("q3") - F.col("q1"), F.lit(4 / 256))
    return found.select("lang", (F.col("q1") - spread[0] * width).alias("low"),
                        (F.col("q3") + spread[1] * width + 1 / 256).alias("high"))


def quality(docs: DataFrame, order: int = ORDER, spread: tuple[float, float] = SPREAD, **columns) -> DataFrame:
    """
    Every document with its base measures, perplexity, band and verdict.

    ``kept`` is false for documents that fail the base rules or whose perplexity lies outside the
    band of their language.
    """
    spark = docs.sparkSession
    counted, path = scratch(spark, "byte-grams"), scratch(spark, "kneser-ney")
    named = {k: v for k, v in columns.items() if k != "id"}
    count_grams(docs, order, **named).write.parquet(counted)
    kneser_ney(spark.read.parquet(counted), order).write.parquet(path)
    rows = measures(docs, spark.read.parquet(path), order, **columns)
    rows = rows.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    ).withColumn("bits", -F.col("loglik") / F.nullif(F.col("n_bytes"), F.lit(0)) / float(np.log(2)))
    path = scratch(spark, "perplexity")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    # One row per language.
    limits = bands(rows, spread, ("digest", "n_bytes", "n_words")).withColumnRenamed("lang", "_lang")
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    return (
        rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .withColumn("perplexity", F.pow(F.lit(2.0), F.col("bits")))
        .withColumn("kept", ~F.col("base_failed") & inside)
        .drop("_lang", "digest")
    )
