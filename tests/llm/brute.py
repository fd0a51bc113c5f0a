"""Plain Python versions of what the operators must return."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_quality(text):
    text = text or ""
    found = words(text)
    lines, seen, repeats = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            repeats += line in seen
            seen.add(line)
    at: dict = {}
    for i in range(len(found) - 2):
        at.setdefault(tuple(found[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    n = len(found)
    return (n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def ids_crc32(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def removed(docs, window=50):
    """doc_id -> (n_words, n_removed, kept_sha256); docs: (doc_id, text), ids all different."""
    first: dict = {}
    split = {d: words(t) for d, t in docs}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), sha(" ".join(kept)))
    return out


def shingles(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def links(docs, threshold=0.8):
    """doc_id -> (class, n_links): links of Jaccard similarity >= threshold, classes by chains of links."""
    sets = {d: shingles(t) for d, t in docs}
    near = {d: set() for d in sets}
    by: dict = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    tried = set()
    for group in by.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12:
                        near[a].add(b)
                        near[b].add(a)
    found: dict = {}
    for d in sorted(sets):
        if d not in found:
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in found:
                    found[x] = d
                    todo += near[x]
    return {d: (found[d], len(near[d])) for d in sets}
