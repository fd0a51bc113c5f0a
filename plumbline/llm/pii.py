"""
Personal data by weak supervision.

Base rules find e-mail addresses, IP addresses, card and phone numbers; those spans always stay. Looser
patterns propose further spans. Labelers (patterns, gazetteers, context words) vote on every
span: +1, 0 or -1. Spark counts how often each combination of votes and shape occurs in all texts;
expectation-maximisation over these counts estimates how reliable each labeler is, and a logistic
span classifier is trained on the resulting probabilities. Proposed spans that it finds at
least ``ACCEPT`` likely, and that touch no base span, are added.

A combination is a kind, six votes and one of 16 shapes, so the driver sees 4 * 3^6 * 16 rows at most.
Every pattern runs in time linear in the text, or is started at rare characters only.

Defined results: a null or empty text has no spans; repeated rows are returned as often as they come and
count each time; an empty table gives an empty result; other columns are neither read nor
returned by ``find`` and kept as they are by ``mask``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import slices

# Kinds in the order of results, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")  # runs without @ are passed over
_IP = re.compile(r"[0-9]+(\.[0-9]+\.[0-9]+\.[0-9]+)?")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ACCEPT = 0.9
ROUNDS = 50

# Looser patterns for spans that the base rules leave out.
_LOOSE = {
    "email": re.compile(
        r"[A-Za-z0-9._%+-]{1,64}\x20?[\[({](?:at|AT)[\])}]\x20?[A-Za-z0-9-]{1,63}"
        r"(?:(?:\.|\x20?[\[({](?:dot|DOT)[\])}]\x20?)[A-Za-z0-9-]{1,63}){1,8}"),
    "ip": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "card": re.compile(r"(?<![\w.-])[0-9](?:[\x20.-]?[0-9]){11,18}(?![\w-])"),
    "phone": re.compile(
        r"(?<![\w.+-])(?:00[1-9][\x20().0-9-]{6,20}[0-9]"
        r"|(?:\([2-9][0-9]{2}\)[\x20.-]?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4})(?![\w-])"),
}
# Gazetteers, in the four languages of the documents where words are concerned.
_DOMAINS = frozenset("com org net edu gov io info biz de fr es uk eu ch at be nl it us ca co".split())
_NEAR = {
    "email": frozenset("mail email e-mail contact contacto kontakt contactez schreib write correo courriel".split()),
    "ip": frozenset("ip address host server adresse dirección client addr login".split()),
    "card": frozenset("card credit visa mastercard karte kreditkarte carte tarjeta payment".split()),
    "phone": frozenset("phone tel call telephone telefon téléphone teléfono mobile fax cell appelez llame".split()),
}
_OTHER = frozenset("version v isbn order invoice section figure fig chapter release build bestellung".split())
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|35|36|6011|65")
_TOKEN = re.compile(r"[^\W\d_][\w-]*")
LABELERS = 6
SHAPES = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted, by the base rules."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text) if m[1]]
    if re.search("[0-9]", text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
                  if m[1] and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def spans_with_votes(text: str) -> tuple[list, list]:
    """Base spans, and (start, kind, end, is base, votes, shape) of all candidates."""
    base = base_spans(text)
    out = [(s, k, e, True, *_votes(text, s, k, e, True)) for s, k, e in base]
    if not re.search("[0-9(\\[{]", text):
        return base, out
    for k, kind in enumerate(KINDS):
        if kind == "email" and not re.search(r"[\[({](?:at|AT)[\])}]", text) or kind == "ip" and text.count(":") < 7:
            continue
        for m in _LOOSE[kind].finditer(text):
            if not any(s < m.end() and m.start() < e for s, _, e in base):
                out.append((m.start(), k, m.end(), False, *_votes(text, m.start(), k, m.end(), False)))
    return base, out


def _votes(text: str, start: int, k: int, end: int, base: bool) -> tuple[tuple[int, ...], int]:
    span, kind = text[start:end], KINDS[k]
    digits = _digits(span)
    if kind == "email":
        strict = 1 if base else 0
        listed = 1 if re.split(r"[.\])}\x20]", span.lower())[-1] in _DOMAINS else -1
    elif kind == "ip":
        strict = 1 if base else 0
        listed = 1 if ":" in span or 0 < int(span.split(".")[0][-3:]) < 224 else -1
    elif kind == "card":
        strict = 1 if luhn(digits) else -1
        listed = 1 if _ISSUER.match(digits) else -1
    else:
        strict = 1 if 9 <= len(digits) <= 15 else -1
        listed = 1 if span[0] == "+" or span.startswith("00") or digits[0] in "23456789" else -1
    words = set(_TOKEN.findall(text[max(0, start - 40) : start].lower()))
    near = 1 if words & _NEAR[kind] else 0
    other = -1 if words & _OTHER else 0
    before, after = text[start - 1 : start], text[end : end + 1]
    edge = -1 if before.isalnum() or after.isalnum() else 1
    marks = {c for c in span if c in " .-"}
    even = 1 if len(marks) == 1 else 0 if not marks else -1 if kind == "card" else 0
    shape = min(SHAPES - 1, len(digits) // 2 if kind in ("card", "phone") else (end - start) // 8)
    return (strict, listed, near, other, edge, even), shape


class SpanModel:
    """Reliabilities and classifier weights of each kind, from counts of votes and shapes."""

    def __init__(self, counts: Counter):
        self.weights: dict[int, np.ndarray] = {}
        self.reliability: dict[int, np.ndarray] = {}
        for k in range(len(KINDS)):
            mine = sorted((votes, shape, n) for (kind, votes, shape), n in counts.items() if kind == k)
            if mine:
                votes = np.array([v for v, _, _ in mine])
                n = np.array([c for _, _, c in mine], float)
                likely, self.reliability[k] = self.estimate(votes, n)
                self.weights[k] = self._fit(self.features(votes, np.array([s for _, s, _ in mine])), likely, n)

    @staticmethod
    def estimate(votes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How likely each combination is personal data, and P(vote | class) of each labeler."""
        likely = 1 / (1 + np.exp(-votes.sum(1)))
        # Prior counts: a labeler that votes is right more often than wrong.
        prior = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])
        for _ in range(ROUNDS):
            weight = np.stack([n * (1 - likely), n * likely])
            table = np.stack([
                np.stack([(weight * (votes[:, j] == v)).sum(1) for v in (-1, 0, 1)], 1) + prior
                for j in range(votes.shape[1])
            ])
            table /= table.sum(2, keepdims=True)
            share = (weight.sum(1) + 1) / (weight.sum() + 2)
            score = np.log(share)[:, None] + sum(
                np.log(table[j][:, votes[:, j] + 1]) for j in range(votes.shape[1]))
            likely = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
        return likely, table

    @staticmethod
    def features(votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(votes), 1))]
        parts += [(votes[:, j : j + 1] == np.array([-1, 1])).astype(float) for j in range(votes.shape[1])]
        parts.append((shapes[:, None] == np.arange(SHAPES)).astype(float))
        return np.hstack(parts)

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.zeros(x.shape[1])
        scale = n / n.sum() * min(n.sum(), 10_000)
        for _ in range(30):  # Newton steps of the penalised likelihood
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (scale * (p - y)) + 0.1 * w
            hess = (x * (scale * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        return w

    def likely(self, k: int, votes: tuple, shape: int) -> float:
        if k not in self.weights:
            return 0.0
        x = self.features(np.array([votes]), np.array([shape]))[0]
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[k], -30, 30))))

    def spans(self, text: str) -> tuple[list, list]:
        """Base spans, and all spans, as sorted (start, kind, end)."""
        base, found = spans_with_votes(text)
        if not found:
            return [], []
        added = [(s, k, e) for s, k, e, is_base, votes, shape in found
                 if not is_base and self.likely(k, votes, shape) >= ACCEPT]
        kept: list = []
        for s, k, e in sorted(added, key=lambda x: (x[0] - x[2], x[0], x[1])):  # longest first
            if not any(a < e and s < b for a, _, b in kept):
                kept.append((s, k, e))
        return base, sorted(base + kept)


def train(docs: DataFrame, text: str = "text") -> SpanModel:
    """Count votes and shapes in all texts, and fit the model of each kind."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for value in batch.column("text"):
                for _, k, _, _, votes, shape in spans_with_votes(value.as_py() or "")[1]:
                    found[k, votes, shape] += 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in keys], pa.int32()), pa.array([list(v) for _, v, _ in keys], pa.list_(pa.int32())),
             pa.array([s for _, _, s in keys], pa.int32()), pa.array([found[x] for x in keys], pa.int64())],
            ["kind", "votes", "shape", "n"])

    counts = docs.select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@(\\[{]")).mapInArrow(
        count, "kind int, votes array<int>, shape int, n bigint")
    # At most 4 * 3^6 * 16 rows.
    rows = counts.groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n")).collect()
    return SpanModel(Counter({(r.kind, tuple(r.votes), r["shape"]): r.n for r in rows}))


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find(docs: DataFrame, model: SpanModel | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every document, both arrays of (kind, start, end) in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, text))

    def work(batches):
        known = shared.value
        form = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        for batch in slices(batches, "text"):
            both = [known.spans(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([named(b) for b, _ in both], form), pa.array([named(a) for _, a in both], form)],
                ["doc_id", "base", "spans"])

    return docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        work, f"doc_id bigint, base {_SPANS}, spans {_SPANS}")


def mask(docs: DataFrame, model: SpanModel | None = None, text: str = "text") -> DataFrame:
    """The same rows with every span of ``text`` replaced by its kind in angle brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, text))

    def masked(value: str | None) -> str | None:
        if not value:
            return value
        parts, at = [], 0
        for s, k, e in shared.value.spans(value)[1]:
            if s >= at:
                parts += [value[at:s], f"<{KINDS[k]}>"]
            at = max(at, e)
        return "".join([*parts, value[at:]])

    def work(batches):
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(
                [masked(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type))

    return docs.mapInArrow(work, docs.schema)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
