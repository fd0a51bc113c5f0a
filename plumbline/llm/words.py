"""
Words of whole Arrow text columns, as numpy arrays.

A word is a run of bytes other than the six ASCII blanks (``[^\\x20\\x09-\\x0D]+``). All words of a
slice of rows are found and hashed by a fixed number of vector operations; no Python code runs per
word. Slices are cut by bytes, so memory does not depend on how many long texts come together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4 << 20
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LONG = 64  # bytes; longer words are hashed one by one


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of the public splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and where each row starts; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    width = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64) - first


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        start, rows = 0, batch.num_rows
        while start < rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(rows, max(end, start + 1))
            yield batch.slice(start, end - start)
            start = end


@dataclass
class Words:
    raw: np.ndarray  # bytes of all rows
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    rows: np.ndarray  # rows + 1 offsets into the words

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        raw, offsets = text_bytes(column)
        solid = ~_BLANK[raw]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # first byte of each row that has one
        before = np.zeros(len(raw) + 1, bool)
        before[1:] = solid
        before[edges] = False
        after = np.zeros(len(raw) + 1, bool)
        after[: len(raw)] = solid
        after[edges] = False
        starts = np.flatnonzero(solid & ~before[:-1])
        ends = np.flatnonzero(solid & ~after[1:]) + 1
        return cls(raw, starts, ends, np.searchsorted(starts, offsets))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.starts)
        length = self.ends - self.starts
        out = mixed(length.astype(np.uint64) * _STEP)
        if n == 0:
            return out
        padded = np.zeros(len(self.raw) + 8, np.uint8)
        padded[: len(self.raw)] = self.raw
        eight = np.ndarray((len(self.raw) + 1,), "<u8", padded, strides=(1,))
        todo = np.flatnonzero(length <= _LONG)
        done = 0
        while len(todo):
            value = eight[self.starts[todo] + done]
            left = length[todo] - done
            short = left < 8
            keep = np.full(len(todo), 0xFFFFFFFFFFFFFFFF, np.uint64)
            keep[short] = (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            out[todo] = mixed(out[todo] ^ ((value & keep) + _STEP))
            done += 8
            todo = todo[length[todo] > done]
        for i in np.flatnonzero(length > _LONG):
            out[i] = xxhash.xxh3_64_intdigest(self.raw[self.starts[i] : self.ends[i]].tobytes())
        return out

    def grams(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each position on, across rows (see ``whole``)."""
        if len(hashes) < size:
            return np.zeros(0, np.uint64)
        # Joins two runs of known hash into a longer one, doubling the size each round.
        run, span, out, covered = hashes, 1, None, 0
        todo = size
        while True:
            if todo & 1:
                if out is None:
                    out, covered = run, span
                else:
                    m = len(hashes) - covered - span + 1
                    out, covered = mixed(out[:m] * _STEP + run[covered : covered + m]), covered + span
            todo >>= 1
            if not todo:
                return out
            m = len(run) - span
            run, span = mixed(run[:m] * _STEP + run[span : span + m]), span * 2

    def whole(self, size: int) -> np.ndarray:
        """Positions (into the words) from which ``size`` words of the same row follow."""
        room = np.repeat(self.rows[1:], self.counts) - np.arange(len(self.starts))
        return np.flatnonzero(room >= size)

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, positions, "right") - 1
