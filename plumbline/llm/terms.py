"""
Terms of whole Arrow text columns: maximal runs of given bytes, with A-Z lower-cased.

All terms of a slice of rows are found by a fixed number of vector operations; equal ones are brought together by
Arrow's dictionary encoding, so no Python code runs per term.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from plumbline.llm.words import text_bytes

_BYTE = np.arange(256)
_LETTER = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) & (_BYTE < 128)
_LOWER = np.where(_LETTER, _BYTE | 32, _BYTE).astype(np.uint8)
_LETTER_OR_WIDE = _LETTER | (_BYTE >= 128)


def letters_and_wide(raw: np.ndarray) -> np.ndarray:
    """Bytes of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]``: ASCII letters and every code point beyond ASCII."""
    return _LETTER_OR_WIDE[raw]


def latin_letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of ``[A-Za-z\\u00C0-\\u00FF]``: ASCII letters, and 0xC3 (always a lead byte) with the byte after it."""
    lead = raw == 0xC3
    out = _LETTER[raw] | lead
    out[1:] |= lead[:-1]
    return out


@dataclass
class Terms:
    """Which terms each row holds, and how often; ``row`` and ``term`` number rows and ``words``."""

    words: pa.Array
    row: np.ndarray
    term: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, member: Callable[[np.ndarray], np.ndarray]) -> Terms:
        raw, offsets = text_bytes(column)
        inside = member(raw)
        first = np.zeros(len(raw) + 1, bool)  # rows that begin here end the run before
        first[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        starts = np.flatnonzero(begins)
        if not len(starts):
            none = np.zeros(0, np.int64)
            return cls(pa.array([], pa.string()), none, none, none)
        held = np.concatenate([[0], np.cumsum(inside)])
        edges = np.append(held[starts], held[-1]).astype(np.int32)
        runs = pa.Array.from_buffers(pa.string(), len(starts), [
            None, pa.py_buffer(edges.tobytes()), pa.py_buffer(_LOWER[raw[inside]].tobytes())]).dictionary_encode()
        row = np.searchsorted(offsets, starts, "right") - 1
        pair, count = np.unique(row * len(runs.dictionary) + runs.indices.to_numpy(), return_counts=True)
        return cls(runs.dictionary, pair // len(runs.dictionary), pair % len(runs.dictionary), count)
