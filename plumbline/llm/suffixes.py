"""
Removal of repeated byte strings with suffix arrays, built block by block on a difference cover.

1. Equal texts become one text. Every window of ``WINDOW`` bytes picks the smallest hash of its k-byte strings, so equal
   windows pick equal keys. Consecutive windows of one key form a span, about every 70 bytes. Only spans whose key
   comes twice can hold a repeated window; their bytes are cut out, and equal spans become one.
2. Spans of like key meet in a bucket, in one task. There the suffixes of the spans' text are sorted: positions
   whose residue modulo 31 lies in a difference cover are ranked first, by prefix doubling in steps of that period. Then one
   block of suffixes at a time (those of some leading bytes) is sorted by 31 bytes, and ties are settled by the ranks:
   any two positions i, j have a common shift d < 31 at which i + d and j + d are both ranked. Neighbours in that
   order that agree in ``WINDOW`` bytes are repeated windows.
3. A key that more than ``HOT`` different spans share is not sorted in one place: those spans are taken as texts and cut anew with a
   larger k, so that they part by what they have in common, up to k = ``WINDOW``, where a key is a window.
4. Repeated ranges go back from spans to their places, and the texts are cut.

A bucket's memory is its text (about ``BUCKET_BYTES``), a rank for each byte and one block of suffixes.

Defined results: a null or empty text has no bytes; texts under ``WINDOW`` bytes are kept; a text that comes twice is removed
whole, in every row; strings are judged on the input and overlaps count, so a run of one letter is removed from its
start; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import mixed, slices, text_bytes
from plumbline.session import scratch

WINDOW = 200
FIRST_KEY = 64  # bytes of a key at first
HOT = 8192  # different spans of one key that are sorted together
BUCKET_BYTES = 4 << 20
BLOCK = 1 << 19  # suffixes sorted at a time
SLICE_BYTES = 1 << 20

# A perfect difference set, whose differences give every residue of its period.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)

_SEED = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_LOW = np.uint64(0xFF)


def _shifts() -> np.ndarray:
    """For two residues the least shift that takes both into the cover."""
    table = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            table[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return table


SHIFT = _shifts()


def string_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position on."""
    if len(raw) < size:
        return np.zeros(0, np.uint64)
    run, span, out, covered, todo = _SEED[raw], 1, None, 0, size
    while True:
        if todo & 1:
            if out is None:
                out, covered = run, span
            else:
                m = len(raw) - covered - span + 1
                out = out[:m] * np.uint64(pow(_BASE, span, 1 << 64)) + run[covered : covered + m]
                covered += span
        todo >>= 1
        if not todo:
            return mixed(out)
        m = len(run) - span
        run, span = run[:m] * np.uint64(pow(_BASE, span, 1 << 64)) + run[span : span + m], span * 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position on."""
    low, span = values, 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return np.minimum(low[: len(values) - width + 1], low[width - span :])


def key_spans(raw: np.ndarray, offsets: np.ndarray, k: int, window: int = WINDOW
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, byte after, key, whether the key may come twice inside) of every span; bytes within their row."""
    sizes = np.diff(offsets)
    room = np.maximum(sizes - window + 1, 0)
    if not room.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    row = np.repeat(np.arange(len(sizes)), room)
    at = np.arange(len(row)) - np.repeat(np.cumsum(room) - room, room) + offsets[:-1][row]
    # The low byte tells places apart: the least and the greatest place of equal hashes differ if there are two.
    hashes, place, width = string_hashes(raw, k) & ~_LOW, np.arange(len(raw) - k + 1).astype(np.uint64) & _LOW, window - k + 1
    low = _least(hashes | place, width)[at]
    twice = (low & _LOW) != _LOW - (_least(hashes | (_LOW - place), width)[at] & _LOW)
    key = (low & ~_LOW).view(np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    start = at[first] - offsets[:-1][row[first]]
    return row[first], start, start + (last - first) + window, key[first], np.logical_or.reduceat(twice, first)


def _eight(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as a number that sorts like them; ``text`` ends in eight spare bytes at least."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))


def _lead_keys(text: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The first ``PERIOD`` bytes as numbers."""
    eight = _eight(text)
    keys = [eight[at + k].astype(np.uint64) for k in (0, 8, 16, 24)]
    keys[3] >>= np.uint64(8)
    return keys


def _changes(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def cover_ranks(text: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes at covered positions by ``depth`` bytes or more, 0 elsewhere; ``text`` is padded with ``depth`` bytes."""
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.zeros(n + 16 * PERIOD + depth, np.int64)
    keys = _lead_keys(text, at)
    order = np.lexsort(keys[::-1])
    rank[at[order]] = np.cumsum(_changes(*[k[order] for k in keys]))
    width = PERIOD
    while width < depth:
        pair = rank[at] * (len(at) + 1) + rank[at + width]
        rank[at] = np.unique(pair, return_inverse=True)[1] + 1
        width *= 2
    return rank


def _settle(at: np.ndarray, new: np.ndarray, rank: np.ndarray) -> None:
    """Sort suffixes that agree in ``PERIOD`` bytes, in place; ``new`` marks where a group of equals begins."""
    edges = np.append(np.flatnonzero(new), len(at))
    active = np.repeat(np.diff(edges) > 1, np.diff(edges))
    while active.any():
        here = np.flatnonzero(active)
        first = np.flatnonzero(new[here])
        size = np.diff(np.append(first, len(here)))
        pivot = np.repeat(at[here[first + size // 2]], size)
        group, own = np.repeat(np.arange(len(first)), size), at[here]
        shift = SHIFT[own % PERIOD, pivot % PERIOD]
        side = np.sign(rank[own + shift] - rank[pivot + shift])
        order = np.lexsort((side, group))
        at[here], side = own[order], side[order]
        begins = _changes(group, side)
        new[here] = begins
        edges = np.append(np.flatnonzero(begins), len(here))
        active[here] = np.repeat((np.diff(edges) > 1) & (side[edges[:-1]] != 0), np.diff(edges))


def sorted_blocks(text: np.ndarray, starts: np.ndarray, rank: np.ndarray, block: int = BLOCK
                  ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes at ``starts`` in order, one block of leading bytes at a time, and which differ from the one before."""
    lead = text[starts].astype(np.uint16) << 8 | text[starts + 1]
    order = np.argsort(lead, kind="stable")
    edges = np.append(np.flatnonzero(_changes(lead[order])), len(order))
    begin = 0
    while begin < len(order):
        k = max(np.searchsorted(edges, begin + block, "right") - 1, np.searchsorted(edges, begin, "right"))
        at = starts[order[begin : edges[k]]]
        begin = edges[k]
        keys = _lead_keys(text, at)
        by = np.lexsort(keys[::-1])
        at, new = at[by], _changes(*[x[by] for x in keys])
        del keys, by
        _settle(at, new, rank)
        yield at, new


def repeated_windows(raw: np.ndarray, starts: np.ndarray, window: int = WINDOW, block: int = BLOCK) -> np.ndarray:
    """Sorted ``starts`` of windows that come at another start too."""
    text = np.concatenate([raw, np.zeros(window + 16 * PERIOD, np.uint8)])
    rank, eight, found = cover_ranks(text, len(raw), window), _eight(text), []
    for at, new in sorted_blocks(text, starts, rank, block):
        same = ~new
        same[0] = False
        todo = np.flatnonzero(new)[1:]  # ranks reach beyond a window: neighbours that differ may agree in its bytes
        for k in [*range(0, window - 7, 8), max(window - 8, 0)]:
            todo = todo[eight[at[todo] + k] == eight[at[todo - 1] + k]]
        same[todo] = True
        either = same.copy()
        either[:-1] |= same[1:]
        found.append(at[either])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _sorter(window: int, block: int) -> Callable[[pa.Table], pa.Table]:
    def work(spans: pa.Table) -> pa.Table:
        spans = spans.combine_chunks()
        _, which, members = np.unique(spans.column("key").to_numpy(), return_inverse=True, return_counts=True)
        # A span alone with its key is like no other; a span found in two places is repeated whole, and sorted for others.
        spans = spans.filter(pa.array((members[which] > 1) | spans.column("twice").to_numpy(zero_copy_only=False)))
        none = pa.table({"id": pa.array([], pa.binary()), "begin": pa.array([], pa.int64()), "end": pa.array([], pa.int64())})
        if not spans.num_rows:
            return none
        raw, offsets = text_bytes(spans.column("span").combine_chunks())
        room = np.diff(offsets) - window + 1
        starts = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + np.repeat(offsets[:-1], room)
        found = repeated_windows(raw, starts, window, block)
        row = np.searchsorted(offsets, found, "right") - 1
        once = (spans.column("places").to_numpy() == 1)[row]
        found, row = found[once], row[once]
        if not len(found):
            return none
        new = _changes(row)
        new[1:] |= found[1:] - found[:-1] > window
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(found)) - 1
        row = row[first]
        return pa.table({"id": spans.column("id").take(pa.array(row)).combine_chunks().cast(pa.binary()),
                         "begin": pa.array(found[first] - offsets[row]), "end": pa.array(found[last] + window - offsets[row])})

    return work


def _next_key(k: int, window: int) -> int:
    return k + -(-(window - k) // 2)


def repeated_ranges(units: DataFrame, k: int = FIRST_KEY, window: int = WINDOW, hot: int = HOT,
                    bucket: int = BUCKET_BYTES, block: int = BLOCK) -> DataFrame:
    """(id, begin, end): bytes of windows that come twice in all texts; units: (id binary, text binary), each text once."""
    spark = units.sparkSession

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.option("compression", "zstd").parquet(path := scratch(spark, name))
        return spark.read.parquet(path)

    def find(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            row, start, end, key, twice = key_spans(*text_bytes(batch.column("text")), k, window)
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row)), pa.array(start), pa.array(end), pa.array(key), pa.array(twice)],
                    ["id", "start", "end", "key", "twice"])

    def cut(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            raw, offsets = text_bytes(batch.column("text"))
            data, at = raw.tobytes(), batch.column("at")
            flat = at.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
            start, end, key, twice = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "key", "twice"))
            base = offsets[:-1][row]
            spans = [data[a:b] for a, b in zip((base + start).tolist(), (base + end).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(start), pa.array(key), pa.array(twice), pa.array(spans, pa.binary())],
                ["id", "start", "key", "twice", "span"])

    places = stored(units.select("id", "text").mapInArrow(find, "id binary, start bigint, end bigint, key bigint, twice boolean"), "places")
    shared = places.groupBy("key").agg(F.count("*").alias("times"), F.max("twice").alias("again")).filter("times > 1 OR again")
    listed = places.join(shared.select("key"), "key", "left_semi").groupBy("id").agg(
        F.collect_list(F.struct("start", "end", "key", "twice")).alias("at"))  # the places of one text
    spans = stored(units.select("id", "text").join(listed, "id").mapInArrow(
        cut, "id binary, start bigint, key bigint, twice boolean, span binary").withColumn("span_id", F.unhex(F.md5("span"))), "spans")
    different = stored(spans.groupBy("span_id").agg(
        F.first("span").alias("span"), F.first("key").alias("key"), F.first("twice").alias("twice"),
        F.count("*").alias("places")).withColumnRenamed("span_id", "id"), "different-spans")

    crowded = stored(different.groupBy("key").agg(F.count("*").alias("members")).filter(F.col("members") > hot).select("key"), "crowded")
    more = k < window and not crowded.isEmpty()
    together = different.join(crowded, "key", "left_anti") if more else different
    size = different.agg(F.sum(F.octet_length("span"))).first()[0] or 0  # one number
    buckets = max(1, -(-size // bucket))
    found = together.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(
        _sorter(window, block), "id binary, begin bigint, end bigint")
    found = found.unionByName(different.filter("places > 1").select(
        "id", F.lit(0).cast("bigint").alias("begin"), F.octet_length("span").cast("bigint").alias("end")))
    if more:
        parted = different.join(crowded, "key", "left_semi").selectExpr("id", "span AS text")
        found = found.unionByName(repeated_ranges(parted, _next_key(k, window), window, hot, bucket, block))
    back = spans.select("id", "start", "span_id").join(found.withColumnRenamed("id", "span_id"), "span_id")
    return back.selectExpr("id", "start + begin AS begin", "start + end AS end")


def _cutter(batches):
    for batch in batches:
        kept, gone, runs = [], [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges")):
            data = text.as_buffer()
            cover = np.zeros(len(data) + 1, np.int64)
            flat = ranges.values
            np.add.at(cover, flat.field("begin").to_numpy(), 1)
            np.add.at(cover, flat.field("end").to_numpy(), -1)
            removed = np.cumsum(cover[:-1]) > 0
            kept.append(np.frombuffer(data, np.uint8)[~removed].tobytes())
            gone.append(int(removed.sum()))
            runs.append(int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
            ["id", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, give: Callable[[Column], Column] = lambda kept: kept, id: str = "doc_id", text: str = "text",
                   window: int = WINDOW, k: int = FIRST_KEY, hot: int = HOT, bucket: int = BUCKET_BYTES, block: int = BLOCK) -> DataFrame:
    """
    (doc_id, n_bytes, n_removed, n_spans, kept): every document without the bytes of windows that come twice.

    ``give`` says what to return of the kept bytes, so that a digest of them need not move the bytes themselves.
    """
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    docs = docs.select(F.col(id).alias("doc_id"), raw.alias("raw")).withColumn("id", F.unhex(F.md5("raw")))
    docs.filter(F.octet_length("raw") >= window).groupBy("id").agg(
        F.first("raw").alias("text"), F.count("*").alias("copies")).write.option("compression", "zstd").parquet(
        path := scratch(spark, "texts"))
    units = spark.read.parquet(path)
    ranges = repeated_ranges(units, k, window, hot, bucket, block)
    single = units.filter("copies = 1").select("id", "text")
    cut = single.join(ranges.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("ranges")), "id").mapInArrow(
        _cutter, "id binary, n_removed bigint, n_spans bigint, kept binary")
    copied = units.filter("copies > 1").select(
        "id", F.octet_length("text").cast("bigint").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"),
        F.lit(b"").alias("kept"))
    changed = cut.unionByName(copied).select(F.col("id").alias("_id"), "n_removed", "n_spans", give(F.col("kept")).alias("kept"))
    own = docs.select("doc_id", "id", F.octet_length("raw").cast("bigint").alias("n_bytes"), give(F.col("raw")).alias("own"))
    return own.join(changed, F.col("id") == F.col("_id"), "left").select(
        "doc_id", "n_bytes", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_removed", "n_spans")],
        F.coalesce("kept", "own").alias("kept"))
