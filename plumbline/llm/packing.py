"""
Best-fit packing of tokenised documents by local search.

Each task tokenises its documents, cuts those longer than a sequence (the first piece takes the
remainder) and packs the pieces: best fit first, then exchanges between underfull sequences. A
fuller sequence takes a document, or one for one, or two for one, from emptier ones whenever its
fill grows, which raises the sum of squared fills, until the emptier ones are empty. Pieces
are packed in blocks of ``BLOCK_TOKENS``; what is in underfull sequences moves on to the next block, so
a task leaves about one sequence unfilled. Nothing is shuffled and memory is bounded by the block.

Defined results: a null or empty text is the end id alone; repeated rows are packed each for itself;
an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tokens import Encoder
from plumbline.llm.words import slices

LENGTH = 1024
END_ID = 2
BLOCK_TOKENS = 2_000_000
SLICE_BYTES = 2 << 20  # of text tokenised at a time; index arrays take about 20 times as much
DONORS = 4  # of the emptiest sequences, those tried for two-for-one exchanges

SCHEMA = ("doc_id bigint, piece int, start bigint, length bigint, sequence_id bigint, "
          "offset bigint, ids binary")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of item numbers: largest item first, into the fullest that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set when some sequence has r tokens of room
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fit = rooms >> size
        if fit:
            room = (fit & -fit).bit_length() - 1 + size
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[chosen].append(item)
        else:
            room, chosen = capacity, len(bins)
            bins.append([item])
        left = room - size
        by_room[left].append(chosen)
        rooms |= 1 << left
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Exchange items between underfull sequences until none can be filled further."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    order = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: (-fill[b], b))
    holders: dict[int, dict[int, int]] = {}  # size -> sequence -> how many, emptiest last
    present = 0
    for b in order:
        for i in bins[b]:
            holders.setdefault(sizes[i], {}).setdefault(b, 0)
            holders[sizes[i]][b] += 1
            present |= 1 << sizes[i]

    def forget(b: int, size: int) -> None:
        nonlocal present
        held = holders[size]
        held[b] -= 1
        if not held[b]:
            del held[b]
            if not held:
                present &= ~(1 << size)

    def learn(b: int, size: int) -> None:
        nonlocal present
        held = holders.setdefault(size, {})
        held[b] = held.get(b, 0) + 1
        present |= 1 << size

    def take(b: int, size: int) -> int:
        at = next(k for k, i in enumerate(bins[b]) if sizes[i] == size)
        return bins[b].pop(at)

    alive = len(order)
    for place, b in enumerate(order):
        for i in bins[b]:
            forget(b, sizes[i])
        while alive and bins[b] and fill[b] < capacity:
            while alive > place + 1 and not bins[order[alive - 1]]:
                alive -= 1
            if alive <= place + 1:
                break
            room = capacity - fill[b]
            best = (0, None, ())  # gain, own item's size, sizes taken for it
            fit = present & ((1 << (room + 1)) - 1)
            if fit:
                size = fit.bit_length() - 1
                best = (size, None, (size,))
            for own in {sizes[i] for i in bins[b]}:
                if best[0] == room:
                    break
                fit = present & ((1 << (own + room + 1)) - 1)
                size = fit.bit_length() - 1 if fit else 0
                if size - own > best[0]:
                    best = (size - own, own, (size,))
            donor = None
            if best[0] < room:
                for d in order[max(place + 1, alive - DONORS) : alive]:
                    held = [sizes[i] for i in bins[d]][:32]
                    for x in range(len(held)):
                        for y in range(x):
                            pair = held[x] + held[y]
                            if pair <= room and pair > best[0]:
                                best, donor = (pair, None, (held[x], held[y])), d
                            for own in {sizes[i] for i in bins[b]}:
                                if best[0] < pair - own <= room:
                                    best, donor = (pair - own, own, (held[x], held[y])), d
            gain, own, wanted = best
            if gain <= 0:
                break
            if donor is None or len(wanted) == 1:
                donor = next(reversed(holders[wanted[0]]))
            for size in wanted:
                forget(donor, size)
                bins[b].append(take(donor, size))
            if own is not None:
                bins[donor].append(take(b, own))
                learn(donor, own)
            fill[b] += gain
            fill[donor] -= gain
    return [b for b in bins if b]


def pack_sizes(sizes: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item its sequence (from 0) and offset there; and the fill of each sequence."""
    which, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    whole = np.flatnonzero(sizes == capacity)
    which[whole] = np.arange(len(whole))
    rest = np.flatnonzero(sizes < capacity)
    small = sizes[rest].tolist()
    fills = [capacity] * len(whole)
    for b in improve(best_fit(small, capacity), small, capacity):
        at = 0
        for i in b:
            which[rest[i]], offset[rest[i]] = len(fills), at
            at += small[i]
        fills.append(at)
    return which, offset, np.array(fills, np.int64)


def _pieces(batch: pa.RecordBatch, encoder: Encoder, length: int, end_id: int) -> pa.Table:
    """One row per piece of the batch's documents."""
    ids, bounds = encoder(batch.column("text"))
    ids = np.insert(ids, bounds[1:], end_id)
    bounds = bounds + np.arange(len(bounds))
    total = np.diff(bounds)
    n = -(-total // length)
    row = np.repeat(np.arange(len(total)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = total - (n - 1) * length
    start = np.where(piece == 0, 0, first[row] + (piece - 1) * length)
    size = np.where(piece == 0, first[row], length)
    edges = np.append(bounds[:-1][row] + start, len(ids)).astype(np.int64) * 4
    held = pa.Array.from_buffers(
        pa.large_binary(), len(row), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]
    ).cast(pa.binary())
    return pa.table({
        "doc_id": batch.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()),
        "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "ids": held,
    })


def pack(docs: DataFrame, ranks: bytes, length: int = LENGTH, end_id: int = END_ID,
         id: str = "doc_id", text: str = "text", block: int = BLOCK_TOKENS) -> DataFrame:
    """
    Every document's pieces with their place in a sequence and their ids (little-endian 32 bit).

    ``ranks`` holds the vocabulary as read from a file of ranks; its size is that file's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def work(batches):
        encoder = Encoder(shared.value)
        base, used = TaskContext.get().partitionId() << 40, 0
        held: list[pa.Table] = []
        tokens = 0

        def placed(last: bool):
            nonlocal held, tokens, used
            if not held:
                return
            table = pa.concat_tables(held)
            sizes = table.column("length").to_numpy()
            which, offset, fills = pack_sizes(sizes, length)
            wait = np.zeros(len(sizes), bool) if last else (fills < length)[which]
            table = table.append_column("sequence_id", pa.array(base + used + which))
            table = table.append_column("offset", pa.array(offset))
            used += len(fills)
            keep = table.filter(pa.array(wait)).select(held[0].column_names)
            held = [keep] if keep.num_rows else []
            tokens = int(pc.sum(keep.column("length")).as_py() or 0)
            out = table.filter(pa.array(~wait)).select(
                ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"])
            yield from out.to_batches(max_chunksize=5000)

        for batch in slices(batches, "text", SLICE_BYTES):
            held.append(_pieces(batch, encoder, length, end_id))
            tokens += int(pc.sum(held[-1].column("length")).as_py())
            if tokens >= block:
                yield from placed(False)
        yield from placed(True)

    return docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, SCHEMA)
