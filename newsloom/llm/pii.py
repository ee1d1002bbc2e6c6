"""Personal data by weak supervision.

Candidates are spans of a fixed form (the base kinds, which always stay) or of
a doubtful one. Labelers vote on every candidate: patterns on its form,
gazetteers on its parts, context on the words beside it. Votes are counted per
combination over the whole corpus; expectation-maximisation on these counts
estimates how reliable each labeler is, and the resulting beliefs train a
logistic span classifier, which decides on the doubtful candidates. The number
of combinations is bounded by the labelers, not by the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_rows, rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mail_words", "local_phone", "number_id", "iban", "titled_name")
GOOD, BAD, ABSTAIN = 1, 0, 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DOUBTFUL = {
    "mail_words": re.compile(r"\b[A-Za-z0-9._-]{2,40} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,40} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}\b"),
    "local_phone": re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    "number_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "titled_name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra|Sr)\.? [A-Z][a-z]{2,20}(?: [A-Z][a-z]{2,20})?\b"),
}
_NEEDS = {"mail_words": re.compile(r"\bdot\b"), "titled_name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra|Sr)\b")}

#: Fixed values of the gazetteer and context labelers.
TOP_DOMAINS = frozenset("com org net edu gov io info de fr es uk eu us co".split())
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PL": 28, "PT": 25, "IE": 22}
CONTEXT_FOR = re.compile(
    r"\b(?:e-?mail|mail|contact|phone|tel|telephone|call|mobile|fax|card|visa|account|iban|host|server|address|ssn|born|name|write|reach|signed|dear)\b", re.I)
CONTEXT_AGAINST = re.compile(r"\b(?:version|isbn|issn|doi|order|invoice|item|figure|table|page|chapter|room|section|release|build|model|serial)\b", re.I)


class Candidate(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]
    shape: int


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain. The local part of a
    match is the run before an @, back to the end of the last match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            floor = found.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *span) for span in _emails(text)]
    if not _DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def _form(kind: str, span: str) -> int:
    digits = re.sub("[^0-9]", "", span)
    if kind in ("email", "mail_words"):
        return GOOD if re.search(r"[A-Za-z]{2}$", span) else BAD
    if kind == "ip":
        return BAD if span.startswith("0.") or len(set(span.split("."))) == 1 else GOOD
    if kind == "number_id":
        return BAD if digits[:3] in ("000", "666") or digits[3:5] == "00" or digits[5:] == "0000" else GOOD
    if kind == "iban":
        plain = span.replace(" ", "")
        return GOOD if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else BAD
    if kind in ("phone", "local_phone"):
        area = digits[-10:-7]
        return ABSTAIN if len(digits) < 10 else BAD if area[:1] in ("0", "1") else GOOD
    return GOOD if kind == "card" else ABSTAIN


def _variety(span: str) -> int:
    kinds = len(set(re.sub("[^0-9A-Za-z]", "", span)))
    return BAD if kinds <= 2 else GOOD if kinds >= 5 else ABSTAIN


def _listed(kind: str, span: str) -> int:
    if kind == "email":
        return GOOD if span.rsplit(".", 1)[1].lower() in TOP_DOMAINS else ABSTAIN
    if kind == "mail_words":
        return GOOD if re.split(r"[^A-Za-z]+", span)[-1].lower() in TOP_DOMAINS else BAD
    if kind == "iban":
        return GOOD if IBAN_LENGTHS.get(span[:2]) == len(span.replace(" ", "")) else BAD
    if kind == "ip":
        return BAD if span.startswith(("127.", "0.")) else ABSTAIN
    return ABSTAIN


def candidates(text: str) -> list[Candidate]:
    """All candidates of a text, base ones first in kind, then by start."""
    fixed = base_spans(text)
    found = list(fixed)
    taken = sorted((a, b) for _, a, b in fixed)
    for kind, pattern in _DOUBTFUL.items():
        guard = _NEEDS.get(kind, _DIGIT)
        if not guard.search(text):
            continue
        for m in pattern.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                found.append((kind, *m.span()))
    out = []
    for kind, start, end in found:
        span = text[start:end]
        before, after = text[max(0, start - 40) : start], text[end : end + 20]
        near = before + " " + after
        glued = (before[-1:].isalnum(), after[:1].isalnum())
        votes = (
            _form(kind, span), _variety(span), _listed(kind, span),
            GOOD if CONTEXT_FOR.search(near) else ABSTAIN,
            BAD if CONTEXT_AGAINST.search(near) else ABSTAIN,
            BAD if any(glued) else GOOD,
        )
        shape = min(3, (end - start) // 10) * 2 + (sum(map(str.isdigit, span)) * 2 > end - start)
        out.append(Candidate(KINDS.index(kind), start, end, kind in BASE, votes, shape))
    return sorted(out, key=lambda c: (c.kind, c.start))


def reliabilities(counts: Counter, rounds: int = 40) -> dict[tuple, float]:
    """Belief that a candidate with these votes is personal data, by
    expectation-maximisation over ``(kind, votes, shape) -> count``. Each kind
    has its own prior; each labeler one table of votes for either class, which
    starts, and is held by its pseudo-counts, on the side of being right."""
    patterns = sorted(counts)
    belief = {p: (1 + p[1].count(GOOD)) / (2 + p[1].count(GOOD) + 2 * p[1].count(BAD)) for p in patterns}
    for _ in range(rounds):
        prior = {}
        for kind in {p[0] for p in patterns}:
            own = [p for p in patterns if p[0] == kind]
            prior[kind] = (1 + sum(counts[p] * belief[p] for p in own)) / (2 + sum(counts[p] for p in own))
        tables = []
        for j in range(len(patterns[0][1]) if patterns else 0):
            seen = [[8.0, 2.0, 6.0], [2.0, 8.0, 6.0]]
            for p in patterns:
                seen[1][p[1][j]] += counts[p] * belief[p]
                seen[0][p[1][j]] += counts[p] * (1 - belief[p])
            tables.append([[x / sum(row) for x in row] for row in seen])
        for p in patterns:
            odds = math.log(prior[p[0]] / (1 - prior[p[0]])) + sum(
                math.log(t[1][v] / t[0][v]) for t, v in zip(tables, p[1]) if v != ABSTAIN)
            belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def _vector(kind: int, votes: tuple[int, ...], shape: int) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 3 * len(votes) + 8)
    x[[0, 1 + kind, *[1 + len(KINDS) + 3 * j + v for j, v in enumerate(votes)], 1 + len(KINDS) + 3 * len(votes) + shape]] = 1
    return x


@dataclass
class SpanClassifier:
    weights: np.ndarray
    threshold: float = 0.8

    def accepts(self, c: Candidate) -> bool:
        return c.base or 1 / (1 + math.exp(-float(self.weights @ _vector(c.kind, c.votes, c.shape)))) >= self.threshold


def fit(counts: Counter, threshold: float = 0.8, steps: int = 30) -> SpanClassifier:
    """Logistic regression on the beliefs, by Newton steps over the counts."""
    size = len(_vector(0, (2,) * 6, 0))
    weights = np.zeros(size)
    if not counts:
        return SpanClassifier(weights, 2.0)
    belief = reliabilities(counts)
    x = np.stack([_vector(*p) for p in belief])
    y = np.array(list(belief.values()))
    n = np.array([float(counts[p]) for p in belief])
    n = n / max(1.0, n.max() / 1000)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (y - p)) - 0.1 * weights
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(size)
        step = np.linalg.solve(bend, slope)
        weights = weights + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return SpanClassifier(weights, threshold)


def train(docs: DataFrame, threshold: float = 0.8) -> SpanClassifier:
    """Votes of the whole corpus, summed per task and then per combination."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for (text,) in rows(batches, "text"):
            if text:
                seen.update((c.kind, c.votes, c.shape) for c in candidates(text))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([list(k[1]) for k in keys], pa.list_(pa.int32())),
             pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["kind", "votes", "shape", "n"])

    counted = map_rows(docs.select("text"), count, "kind int, votes array<int>, shape int, n bigint").groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n"))
    return fit(Counter({(r["kind"], tuple(r["votes"]), r["shape"]): r["n"] for r in counted.collect()}), threshold)


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find(docs: DataFrame, model: SpanClassifier | None = None) -> DataFrame:
    """``doc_id, spans`` per row of ``docs`` (``doc_id, text``; other columns
    are ignored). Spans are ``kind, start, end`` (code points, end exclusive)
    and ``base``, by kind as listed in ``KINDS``, then start.

    Null and empty texts have no spans; repeated rows are searched each; an
    empty table gives an empty result."""
    chosen = model or train(docs)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            spans = [
                [{"kind": KINDS[c.kind], "start": c.start, "end": c.end, "base": c.base} for c in candidates(texts[i].as_py() or "") if chosen.accepts(c)]
                for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), search, f"doc_id bigint, spans {SPANS}")


def redact(text: str | None, model: SpanClassifier) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping
    spans become one, named after the first."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list] = []
    for c in sorted((c for c in candidates(text) if model.accepts(c)), key=lambda c: (c.start, -c.end)):
        if merged and c.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], c.end)
        else:
            merged.append([c.start, c.end, KINDS[c.kind]])
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted_documents(docs: DataFrame, model: SpanClassifier | None = None) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; all rows, same columns."""
    chosen = model or train(docs)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            clean = pa.array([redact(texts[i].as_py(), chosen) for i in range(batch.num_rows)], texts.type)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", clean)

    return map_rows(docs, replace, docs.schema.simpleString().removeprefix("struct<").removesuffix(">"))
