"""
Removal of passages that earlier documents hold already, with Aho-Corasick automata.

1. Every window of 50 words picks the smallest hash of its 16-word phrases. Equal windows pick equal
   phrases, so only windows whose phrase occurs in two documents can recur; about one phrase in 17
   words is counted instead of every window.
2. The windows left are confirmed by their own hash: those found in two documents belong to the
   smallest doc_id. Runs of them there are the recurring passages.
3. Documents that hold windows of a smaller doc_id and their passages are brought together in blocks. Each block compiles an
   automaton of the 25-word tiles of its passages (every window of 50 words holds a whole tile) and
   streams its documents through it. A hit is extended word by word to both sides; where 50 words or
   more agree with a passage of a smaller doc_id, they are removed.

Which phrases recur, and which documents hold confirmed windows, is sent to the tasks as bit tables of
fixed size. Their collisions only let more windows through to step 2 and more documents to step 3. A block's passages are those its own documents hold, so
automata are bounded by the block.

Defined results: a null or empty text has no words; a null doc_id is neither smaller nor larger than any,
so its document keeps all words and takes none away; rows of one doc_id don't affect each
other; texts of under 50 words are kept; an empty table gives an empty result; other columns
are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import Words, mixed, slices, text_bytes
from plumbline.session import scratch

WINDOW = 50
PHRASE = 16
TILE = WINDOW // 2
BITS = 27  # the bit table has 2^27 bits, 16 MB
BLOCK_BYTES = 6 << 20
LETTERS = 1_000_000  # code points that stand for words in an automaton


def window_phrases(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows, and the smallest phrase hash in each."""
    at = words.whole(WINDOW)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    low, span, width = mixed(words.grams(hashes, PHRASE)), 1, WINDOW - PHRASE + 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return at, np.minimum(low[at], low[at + width - span])


def _runs(*parts: np.ndarray) -> np.ndarray:
    """Where a new run begins, in arrays of equal length."""
    new = np.ones(len(parts[0]), bool)
    new[1:] = np.any([p[1:] != p[:-1] for p in parts], axis=0)
    return np.flatnonzero(new)


def _phrases(docs: DataFrame) -> DataFrame:
    """(phrase, doc_id) of all documents."""

    def work(batches):
        for batch in slices(batches, "text"):
            words = Words.of(batch.column("text"))
            at, phrase = window_phrases(words, words.hashes())
            if len(at):
                row = words.row_of(at)
                first = _runs(row, phrase)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(phrase[first].view(np.int64)), batch.column("doc_id").take(pa.array(row[first]))],
                    ["phrase", "doc_id"])

    return docs.mapInArrow(work, "phrase bigint, doc_id bigint")


def _bit_table(keys: DataFrame) -> np.ndarray:
    """Bits set at the keys' places; at most 2^(BITS - 6) rows come to the driver."""
    place = F.pmod(F.col("key"), F.lit(1 << BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = keys.select(F.shiftright(place, 6).alias("at"), bit.alias("bit"))
    found = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def _in_table(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64((1 << BITS) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _candidates(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, text, windows): runs of windows whose phrase may recur, and the windows' hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches):
        bits = shared.value
        for batch in slices(batches, "text"):
            words = Words.of(batch.column("text"))
            hashes = words.hashes()
            at, phrase = window_phrases(words, hashes)
            if not len(at):
                continue
            at = at[_in_table(bits, phrase)]
            if not len(at):
                continue
            row = words.row_of(at)
            first = _runs(row, at - np.arange(len(at)))
            last = np.append(first[1:], len(at)) - 1
            begin, end = words.starts[at[first]], words.ends[at[last] + WINDOW - 1]
            data = words.raw.tobytes()
            text = pa.array([data[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())], pa.string())
            values = words.grams(hashes, WINDOW)[at].view(np.int64)
            windows = pa.ListArray.from_arrays(np.append(first, len(at)).astype(np.int32), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row[first])), text, windows], ["doc_id", "text", "windows"])

    return docs.mapInArrow(work, "doc_id bigint, text string, windows array<bigint>")


def _passages(held: DataFrame) -> DataFrame:
    """(owner, text): runs of owned windows, each window once; held: (doc_id, text, windows, owned)."""

    def work(batches):
        for batch in batches:
            owners, texts = [], []
            for r in range(batch.num_rows):
                windows = batch.column("windows")[r].values.to_numpy(zero_copy_only=False)
                owned = batch.column("owned")[r].values.to_numpy(zero_copy_only=False)
                mine = np.isin(windows, owned)
                once = np.zeros(len(windows), bool)
                once[np.unique(windows, return_index=True)[1]] = True
                at = np.flatnonzero(mine & once)
                if len(at):
                    words = batch.column("text")[r].as_py().encode().split()
                    first = _runs(at - np.arange(len(at)))
                    last = np.append(first[1:], len(at)) - 1
                    for a, b in zip(at[first].tolist(), at[last].tolist()):
                        owners.append(batch.column("doc_id")[r].as_py())
                        texts.append(b" ".join(words[a : b + WINDOW]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(texts, pa.string())], ["owner", "text"])

    return held.mapInArrow(work, "owner bigint, text string")


class Locator:
    """An automaton of the passages' tiles, and the passages for extending its hits."""

    def __init__(self, owners: list[int], texts: pa.Array):
        import ahocorasick

        words = Words.of(texts)
        self.known, ids = np.unique(words.hashes(), return_inverse=True)
        self.owners = owners
        self.passages = [ids[words.rows[p] : words.rows[p + 1]] for p in range(len(texts))]
        tiles: dict[str, list[tuple[int, int]]] = {}
        for p, passage in enumerate(self.passages):
            letters = self.spelled(passage)
            for at in range(0, len(passage) - TILE + 1, TILE):
                tiles.setdefault(letters[at : at + TILE], []).append((p, at))
        self.automaton = ahocorasick.Automaton()
        for tile, places in tiles.items():
            self.automaton.add_word(tile, places)
        if tiles:
            self.automaton.make_automaton()
        self.any = bool(tiles)

    @staticmethod
    def spelled(ids: np.ndarray) -> str:
        """Words as code points; unknown words are one that no tile holds. Hits are checked by id."""
        code = np.where(ids < 0, 1, ids % LETTERS + 2)
        code = np.where(code >= 0xD800, code + 0x800, code)
        return code.astype("<u4").tobytes().decode("utf-32-le")

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)

    def covered(self, doc_id: int | None, ids: np.ndarray) -> np.ndarray:
        """Which words of a document lie in windows of passages with a smaller owner."""
        out = np.zeros(len(ids) + 1, np.int64)
        if self.any and doc_id is not None and len(ids) >= WINDOW:
            done: dict[tuple[int, int], int] = {}
            for end, places in self.automaton.iter(self.spelled(ids)):
                start = end - TILE + 1
                for p, at in places:
                    shift = start - at
                    if self.owners[p] >= doc_id or done.get((p, shift), -1) >= at + TILE:
                        continue
                    passage = self.passages[p]
                    low, high = max(0, -shift), min(len(passage), len(ids) - shift)
                    differ = np.flatnonzero(passage[low:high] != ids[low + shift : high + shift]) + low
                    k = int(np.searchsorted(differ, at))
                    first = int(differ[k - 1]) + 1 if k else low
                    last = int(differ[k]) if k < len(differ) else high
                    done[p, shift] = max(last, at + TILE)
                    if last - first >= WINDOW:
                        out[first + shift] += 1
                        out[last + shift] -= 1
        return np.cumsum(out[:-1]) > 0


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document, with the words kept joined by spaces."""
    spark = docs.sparkSession

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(path := scratch(spark, name))
        return spark.read.parquet(path)

    texts = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    named = texts.filter(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * WINDOW - 1))
    in_two = lambda rows, key: rows.groupBy(key).agg(
        F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last")
    table = _bit_table(in_two(_phrases(named), "phrase").withColumnRenamed("phrase", "key"))
    candidates = stored(_candidates(named, table), "candidates")
    windows = candidates.select("doc_id", F.explode("windows").alias("window"))
    confirmed = stored(in_two(windows, "window").select("window", "owner"), "windows")

    owned = confirmed.groupBy("owner").agg(F.collect_list("window").alias("owned"))  # one document's windows
    passages = stored(_passages(candidates.join(owned, F.col("doc_id") == F.col("owner")).drop("owner")), "passages")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
    hits = stored(windows.join(confirmed.withColumnRenamed("window", "_w"), F.col("window") == F.col("_w")).filter(
        "owner < doc_id").select("doc_id", F.col("owner").alias("_o")).distinct(), "hits")
    routes = hits.select(block.alias("block"), "_o").distinct()
    routed = passages.join(routes, F.col("owner") == F.col("_o")).select("block", "owner", F.col("text").alias("passage"))
    # Documents without a hit, but for collisions, need not meet any passage and stay where they are.
    keyed = texts.withColumn("key", F.xxhash64("doc_id"))
    shared = spark.sparkContext.broadcast(_bit_table(hits.select(F.xxhash64("doc_id").alias("key"))))

    def split(wanted: bool):
        def work(batches):
            for batch in batches:
                keys = batch.column("key").to_numpy().view(np.uint64)
                batch = batch.filter(pa.array(_in_table(shared.value, keys) == wanted))
                if wanted:
                    yield batch.select(["doc_id", "text"])
                else:
                    for part in slices([batch], "text"):
                        raw, offsets = text_bytes(part.column("text"))
                        data = raw.tobytes()
                        own = [data[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id"), pa.array([len(w) for w in own], pa.int64()),
                             pa.array(np.zeros(len(own), np.int64)), pa.array([b" ".join(w) for w in own], pa.binary())],
                            ["doc_id", "n_words", "n_removed", "kept"])
        return work

    result = "doc_id bigint, n_words bigint, n_removed bigint, kept binary"
    untouched = keyed.mapInArrow(split(False), result)
    suspected = keyed.mapInArrow(split(True), "doc_id bigint, text string")

    def locate(held: pa.Table, patterns: pa.Table) -> pa.Table:
        found = Locator(patterns.column("owner").to_pylist(), patterns.column("passage").combine_chunks())
        ids, counts, gone, kept = [], [], [], []
        for batch in slices(held.to_batches(), "text"):
            words = Words.of(batch.column("text"))
            known = found.ids(words.hashes())
            raw, offsets = text_bytes(batch.column("text"))
            data = raw.tobytes()
            for r, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                cover = found.covered(doc_id, known[words.rows[r] : words.rows[r + 1]])
                own = data[offsets[r] : offsets[r + 1]].split()
                ids.append(doc_id)
                counts.append(len(own))
                gone.append(int(cover.sum()))
                kept.append(b" ".join([own[i] for i in np.flatnonzero(~cover)] if gone[-1] else own))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(counts, pa.int64()),
                         "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.binary())})

    located = suspected.withColumn("block", block).groupBy("block").cogroup(routed.groupBy("block")).applyInArrow(
        locate, result)
    return untouched.unionByName(located).withColumn("kept", F.col("kept").cast("string"))

