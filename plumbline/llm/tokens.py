"""
Byte-pair token ids of whole Arrow text columns.

Texts are cut before every single space, and around every single line break, that stands between two
non-blank characters: the public pattern of this vocabulary starts a new piece there anyway, so the
ids stay the same. Equal pieces of a slice are found by Arrow's dictionary encoding and tokenised
once.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa

from plumbline.llm.words import text_bytes

# The public pattern of the vocabulary, and the code points that count as blank.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANKS = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_ASCII_BLANK = np.zeros(256, bool)
_ASCII_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WIDE = [chr(c).encode() for c in BLANKS]


class Encoder:
    """Ids of a vocabulary given as ranks (one base64 token and its rank in each line)."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.vocabulary = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self.line_break = table[b"\n"]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each row's ids start."""
        raw, offsets = text_bytes(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        blank = _ASCII_BLANK[raw]
        for n in (2, 3):
            leads = np.isin(raw, [b[0] for b in _WIDE if len(b) == n])
            for at in np.flatnonzero(leads[: len(raw) - n + 1]):
                if raw[at : at + n].tobytes() in _WIDE:
                    blank[at : at + n] = True
        lone = np.zeros(len(raw) + 1, bool)  # a space or line break between two non-blanks
        lone[1 : len(raw) - 1] = ~blank[:-2] & ~blank[2:] if len(raw) > 2 else False
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        lone[starts] = lone[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
        cut = lone[:-1] & ((raw == 32) | (raw == 10))
        cut[starts] = True
        after = np.flatnonzero(lone[:-1] & (raw == 10)) + 1
        cut[after] = True
        first = np.flatnonzero(cut)
        edges = np.append(first, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(
            pa.binary(), len(first), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(raw.tobytes())]
        ).dictionary_encode()
        sizes, flat = self._encode(pieces.dictionary)
        index = pieces.indices.to_numpy()
        counts = sizes[index]
        ends = np.cumsum(counts)
        begin = (np.cumsum(sizes) - sizes)[index] - (ends - counts)
        out = flat[np.repeat(begin, counts) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])
        return out, bounds[np.searchsorted(edges, offsets)]

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all of them end to end."""
        raw = np.frombuffer(pieces.buffers()[2], np.uint8)
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1].astype(np.int64)
        # Plain pieces hold no blank but one space ahead: a line break between two of them stays a
        # token of its own, so all are tokenised as one text and parted again at the breaks.
        blanks = np.concatenate([[0], np.cumsum(_ASCII_BLANK[raw] | (raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))])
        inner = blanks[offsets[1:]] - blanks[np.minimum(offsets[:-1] + 1, offsets[1:])]
        lead = raw[offsets[:-1]]
        plain = (inner == 0) & ((lead == 32) | (~_ASCII_BLANK[lead] & (lead != 0xC2) & ((lead < 0xE1) | (lead > 0xE3))))
        plain &= ~((lead == 32) & (np.diff(offsets) == 1))
        sizes = np.zeros(len(pieces), np.int64)
        ours = np.repeat(plain, np.diff(offsets))
        ends = np.cumsum(np.diff(offsets)[plain])
        joined = np.insert(raw[: offsets[-1]][ours], ends[:-1], 10).tobytes()
        ids = self.vocabulary.encode_to_numpy(joined.decode()) if joined else np.zeros(0, np.uint32)
        breaks = np.concatenate([[-1], np.flatnonzero(ids == self.line_break), [len(ids)]])
        odd = [self.vocabulary.encode_ordinary(x.decode()) for x in pieces.filter(pa.array(~plain)).to_pylist()]
        if joined:
            sizes[plain] = np.diff(breaks) - 1
        sizes[~plain] = [len(x) for x in odd]
        flat = np.zeros(int(sizes.sum()), np.uint32)
        ours = np.repeat(plain, sizes)
        flat[ours] = ids[ids != self.line_break]
        flat[~ours] = np.fromiter(chain.from_iterable(odd), np.uint32)
        return sizes, flat
