"""Secrets by a linear-chain conditional random field.

Words are tagged as begin of a secret, inside or outside. A word may carry or
announce a secret if it has a digit, a sign, a change to upper case or a key
word; a chain is every run of such words with the ``BEFORE`` words before and
``AFTER`` words behind each, letter-only words included. Features of a word are
its shape, its neighbours and what kind of text it stands in; none is the text
of a fixed form. Words far from all of that are outside, so the best tags of a
text are those of its chains (Viterbi).

The field is trained by maximum likelihood on distinct chains, at most about
``max_chains`` with and as many without a base value, chosen by a hash cutoff
that is computed from counts over all documents. The base values are masked in
part: each is learnt as it is, rewritten (letters only, words run together)
behind other key words, and without any key word; words of the same text take
its place as examples of what is no secret. The base forms always stay as spans,
and the field adds others; without any base value there is nothing to learn from
and it adds none.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Buffer, map_rows, rows

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "tagged")
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
SLOTS = 1 << 13

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_HEX_BYTES = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NAME = (
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
    r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api)?key|auth|cred(?:ential)?)s?(?![a-z])"
)
_KEYS = re.compile(_NAME, re.A)
_STEMS = ("pass", "pwd", "secret", "token", "key", "auth", "cred")
_SIGNS = re.compile("[0-9=_+/]+")
_TURN = re.compile("[A-Z](?<=[a-z][A-Z])")
_OPEN, _CLOSE = "\"'`([{<", "\"'`)]}>,;.!?"
BEFORE, AFTER = 2, 3
KEY_WORDS = ("pwd", "auth_key", "db_pass", "client key", "access-key", "credential", "passphrase", "dbPass", "AUTH")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    folded = text.lower()
    if (":" in text or "=" in text) and any(name in folded for name in _NAMES):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"\1" * 24 in text.encode("utf-8", "replace").translate(_HEX_BYTES):
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


class Chain(NamedTuple):
    spans: list[tuple[int, int]]
    features: list[list[int]]


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % SLOTS


def _core(word: str) -> tuple[str, str]:
    """What stands before the last sign of assignment of a word, and behind it."""
    name, sign, value = word.rpartition("=") if "=" in word.rstrip("=") else word.rpartition(":")
    if not value.strip(_OPEN + _CLOSE + "="):
        name, value = word, ""
    return (name, value) if sign else ("", word)


def _class(word: str) -> str:
    """What a word announces to its neighbours."""
    if not word:
        return "none"
    if not word.strip("=:"):
        return "sign"
    return f"{bool(_KEYS.search(word))}{word[-1] in '=:'}{any(c.isdigit() for c in word)}"


@lru_cache(50_000)
def _own(word: str) -> tuple[tuple[int, ...], str, str]:
    """Slots of a word by itself, its class and the kind of its value."""
    name, value = _core(word)
    value = value.strip(_OPEN + _CLOSE)
    n = max(len(value), 1)
    lower, upper, digit = (any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit))
    signs = sum(not c.isalnum() for c in value)
    codes = ["0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "-" for c in value]
    switches = sum(x != y for x, y in zip(codes, codes[1:]))
    kinds = f"{lower:d}{upper:d}{digit:d}{signs > 0:d}"
    shape = "".join(c for c, before in zip(codes, ["", *codes]) if c != before)[:8]
    consonants = max(map(len, re.split("[^b-df-hj-np-tv-xz]+", value.lower())))
    kind = f"{kinds} {min(n // 4, 6)}"
    names = [
        "bias", f"shape {shape}", f"kinds {kinds}", f"length {min(n // 3, 14)}", f"both {kind}", f"digits {8 * sum(c.isdigit() for c in value) // n}",
        f"distinct {min(len(set(value)) // 3, 8)}", f"switches {kinds} {min(8 * switches // n, 6)} {n > 9}", f"consonants {min(consonants, 7)} {n > 9}",
        f"last letter {max((c for c in value if c.isalpha()), default='')[:1] <= 'f'} {digit} {min(n // 8, 5)}",
        f"mail {'@' in value}", f"dots {min(value.count('.'), 3)}", f"path {'://' in word or '/' in value} {digit}", f"plus {value[:1] == '+'}",
        f"opens {word[:1] in _OPEN}", f"assigned here {bool(name)} {bool(_KEYS.search(name))} {bool(value)} {n > 5}", f"key here {bool(_KEYS.search(word))}",
    ]
    return tuple(_slot(x) for x in names), _class(word), kind


@lru_cache(50_000)
def _around(before2: str, before: str, after: str, kind: str, kind_of_text: str) -> tuple[int, ...]:
    names = [
        f"before {before}", f"before2 {before2} {before}", f"after {after}", f"value {before2} {before} {kind}", f"near {before} {kind}",
        f"text {kind_of_text}",
    ]
    return tuple(_slot(x) for x in names)


def _hints(text: str) -> list[int]:
    """Where digits, signs, changes to upper case and key words stand."""
    found = [m.start() for pattern in (_SIGNS, _TURN) for m in pattern.finditer(text)]
    folded = text.lower()
    if any(stem in folded for stem in _STEMS):
        found += [m.start() for m in _KEYS.finditer(text)]
    return sorted(found)


def _word_runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words that may carry a secret or stand near one that may."""
    hints = _hints(text)
    at = 0
    out: list[list[tuple[int, int]]] = []
    waiting: list[tuple[int, int]] = []  # words that only a later word can bring in
    behind = 0
    for m in _WORD.finditer(text) if hints else ():
        start, end = m.span()
        marked = at < len(hints) and hints[at] < end
        while at < len(hints) and hints[at] < end:
            at += 1
        if marked or behind:
            if behind == 0 and (not out or len(waiting) > BEFORE):
                out.append([])
            if behind == 0:
                out[-1] += waiting[-BEFORE:]
                waiting = []
            out[-1].append((start, end))
            behind = AFTER if marked else behind - 1
        elif at == len(hints):
            break
        else:
            waiting.append((start, end))
            if len(waiting) > BEFORE + 1:
                waiting.pop(0)
    return out


def chains(text: str) -> list[Chain]:
    """Runs of words that carry or neighbour a hint of a secret, with features."""
    runs = _word_runs(text)
    marked = sum(map(len, runs))
    kind_of_text = f"{min(5, 50 * marked // max(len(text) // 6, 1))} {';' in text} {'{' in text}"
    out = []
    for spans in runs:
        own = [_own(text[a:b]) for a, b in spans]
        classes = ["none", "none", *[c for _, c, _ in own], "none"]
        features = [[*slots, *_around(*classes[k : k + 2], classes[k + 3], kind, kind_of_text)] for k, (slots, _, kind) in enumerate(own)]
        out.append(Chain(spans, features))
    return out


def values(text: str) -> list[tuple[int, int]]:
    """Where the secrets themselves stand in the base spans: without a name."""
    out = {m.span(2) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6}
    out |= {(a, b) for kind, a, b in base_spans(text) if kind != "assign"}
    kept: list[tuple[int, int]] = []
    for a, b in sorted(out, key=lambda s: (s[0], -s[1])):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b))
    return kept


def tags_of(chain: Chain, spans: list[tuple[int, int]]) -> list[int]:
    """Tags by known values: words that one of them touches."""
    tags, previous = [], None
    for start, end in chain.spans:
        own = next(((a, b) for a, b in spans if a < end and start < b), None)
        tags.append(OUTSIDE if own is None else INSIDE if own == previous else BEGIN)
        previous = own
    return tags


def masked(text: str, seed: int = 0) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """A training text, and what is made of its base values and of its words so
    that neither the form nor the key word alone decides. Deterministic."""
    known = values(text)
    yield text, known
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace"), seed))
    plain = [w.strip(_OPEN + _CLOSE + ":=") for w in text.split()]
    plain = [w for w in plain if w.isalpha() and 3 <= len(w) <= 12 and not _KEYS.search(w)] or ["word"]
    pick = lambda: rng.choice(plain)

    def put(form: str, value: str, secret: bool) -> tuple[str, list[tuple[int, int]]]:
        left, right = form.split("@@")
        left, right = f"{pick()} {pick()} {left}", f"{right} {pick()} {pick()}"
        return left + value + right, [(len(left), len(left) + len(value))] if secret else []

    def written(letters: str, low: int, high: int) -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))

    def run_together(how) -> str:
        out = ""
        while len(out) < 10:
            out += how(pick())
        return out

    if known:
        a, b = rng.choice(known)
        own = text[a:b]
        every = string.ascii_letters + string.digits
        named = ("{}: @@", "{} = @@", "{}=@@", "{}: \"@@\"", "{} <@@>", "{} is @@", "{} = '@@';")
        for made in (own, written(string.ascii_letters, 10, 28), written(every, 12, 40), written(every + "_-+/", 16, 40),
                     run_together(str.capitalize), run_together(str.lower)):
            for form in rng.sample(named[:5], 2) if made.isalpha() else rng.sample(named, 2):
                yield put(form.format(rng.choice(KEY_WORDS)), made, True)
        for made in (own, written(every, 20, 40), written(every + "+/", 24, 48)):
            yield put("@@", made, True)
    number = str(rng.randint(1, 9999))
    key = rng.choice((*KEY_WORDS, "token", "secret", "key"))
    for form, made in (
        (key + " @@", pick()), (key + ": @@", pick()[:8].lower()), (key + " = @@", number), (key + " is @@", pick()),
        ("@@", pick().lower() + pick().capitalize()), ("@@", f"{pick()}_{pick()}"), ("@@", f"{pick()}/{pick()}"),
        ("@@", f"https://{pick().lower()}.com/{pick().lower()}/{number}"), (pick() + ": @@", pick()), (pick() + " = @@", number),
        ("@@", f"{pick()}{number}"), (f"{key} @@", f"v{number[:1]}.{number[-1:]}"),
    ):
        if rng.random() < 0.5:
            yield put(form, made, False)


@dataclass
class Field:
    emission: np.ndarray  # SLOTS x 3
    step: np.ndarray  # from, to; a secret can't begin inside
    first: np.ndarray

    def best(self, features: list[list[int]]) -> list[int]:
        """Viterbi."""
        scores = np.stack([self.emission[f].sum(0) for f in features])
        value, back = scores[0] + self.first, []
        for x in scores[1:]:
            reach = value[:, None] + self.step
            back.append(reach.argmax(0))
            value = reach.max(0) + x
        tags = [int(value.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(examples: list[tuple[list[list[int]], list[int]]], epochs: int = 60, rate: float = 0.3, decay: float = 1e-3, longest: int = 64) -> Field:
    """Maximum likelihood by adaptive gradient steps; chains of one length are
    worked on together. Chains beyond ``longest`` words are learnt in parts."""
    field = Field(np.zeros((SLOTS, 3)), np.zeros((3, 3)), np.zeros(3))
    field.emission[_slot("bias"), OUTSIDE] = 1.0
    field.step[OUTSIDE, INSIDE] = field.first[INSIDE] = -1e6
    groups: dict[int, list] = defaultdict(list)
    for features, tags in examples:
        for k in range(0, len(tags), longest):
            groups[len(tags[k : k + longest])].append((features[k : k + longest], tags[k : k + longest]))
    seen = [np.full_like(x, 1e-2) for x in (field.emission, field.step, field.first)]
    ready = [(np.array([f for f, _ in g]), np.array([t for _, t in g])) for _, g in sorted(groups.items())]
    total = max(sum(len(t) for _, t in ready), 1)
    for _ in range(epochs):
        slopes = [-decay * field.emission, np.zeros((3, 3)), np.zeros(3)]
        for x, y in ready:
            scores = field.emission[x].sum(2)  # chain, word, tag
            n, length = y.shape
            forward, backward = np.empty_like(scores), np.zeros_like(scores)
            forward[:, 0] = scores[:, 0] + field.first
            for k in range(1, length):
                forward[:, k] = scores[:, k] + _log_sum(forward[:, k - 1, :, None] + field.step, 1)
            for k in range(length - 2, -1, -1):
                backward[:, k] = _log_sum(field.step + (scores[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
            every = _log_sum(forward[:, -1], 1)
            off = -np.exp(forward + backward - every[:, None, None])
            np.put_along_axis(off, y[:, :, None], np.take_along_axis(off, y[:, :, None], 2) + 1, 2)
            flat = x.reshape(-1)
            for tag in range(3):
                slopes[0][:, tag] += np.bincount(flat, np.repeat(off[:, :, tag].reshape(-1), x.shape[2]), SLOTS) / total
            slopes[2] += off[:, 0].sum(0) / total
            for k in range(1, length):
                pair = forward[:, k - 1, :, None] + field.step + (scores[:, k] + backward[:, k])[:, None, :] - every[:, None, None]
                slopes[1] -= np.exp(pair).sum(0) / total
                np.add.at(slopes[1], (y[:, k - 1], y[:, k]), 1 / total)
        for value, slope, sum_ in zip((field.emission, field.step, field.first), slopes, seen):
            sum_ += slope**2
            value += rate * slope / np.sqrt(sum_)
        field.step[OUTSIDE, INSIDE] = field.first[INSIDE] = -1e6
    return field


def learn(texts: list[str], least: int = 150) -> Field:
    """The field from training texts; where few of them have a secret, or few
    have none, these are masked anew until there are ``least``."""
    groups: dict[bool, list[str]] = defaultdict(list)
    for text in texts:
        groups[bool(values(text))].append(text)
    examples = []
    for group in groups.values():
        for seed in range(-(-least // len(group))):
            examples += [(c.features, tags_of(c, known)) for text in group for made, known in masked(text, seed) for c in chains(made)]
    return fit(sorted(examples))


def train(docs: DataFrame, max_chains: int = 600, words: int = 32, longest: int = 4_000) -> Field:
    """The field, learnt from the texts of distinct chains, cut every ``words``
    words. Those with and without a base value are counted apart; the counts
    give a cutoff of a hash for each, and only chains below it travel.
    ``longest``: a chain of more characters is no example."""
    def parts(text: str) -> Iterator[tuple[int, bool, str]]:
        for spans in _word_runs(text):
            for k in range(0, len(spans), words):
                part = text[spans[k][0] : spans[min(k + words, len(spans)) - 1][1]]
                if len(part) <= longest:
                    yield xxhash.xxh64_intdigest(part.encode("utf-8", "replace")) >> 1, bool(values(part)), part

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Buffer(pa.schema([("h", pa.int64()), ("secret", pa.bool_())]))
        for (text,) in rows(batches, "text"):
            for h, secret, _ in parts(text or ""):
                out.add(h, secret)
                if out.full():
                    yield out.take()
        yield out.take()

    counted = map_rows(docs.select("text"), keys, "h bigint, secret boolean").distinct().groupBy("secret").count().collect()
    cutoff = {r["secret"]: min(1.0, max_chains / r["count"]) * 2.0**63 for r in counted}

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Buffer(pa.schema([("h", pa.int64()), ("part", pa.string())]))
        for (text,) in rows(batches, "text"):
            for h, secret, part in parts(text or ""):
                if h < cutoff[secret]:
                    out.add(h, part, weight=len(part))
                    if out.full():
                        yield out.take()
        yield out.take()

    taken = map_rows(docs.select("text"), examples, "h bigint, part string").groupBy("h").agg(F.min("part").alias("part"))
    return learn(sorted(r["part"] for r in taken.collect()))


def spans_of(text: str, field: Field) -> list[tuple[str, int, int]]:
    """All spans by start, then kind. A tagged span that touches a base span
    is that secret again and not added."""
    base = base_spans(text)
    out = list(base)
    for chain in chains(text):
        tags = field.best(chain.features)
        k = 0
        while k < len(tags):
            if tags[k] == OUTSIDE:
                k += 1
                continue
            begin = k
            k += 1
            while k < len(tags) and tags[k] == INSIDE:
                k += 1
            start, end = chain.spans[begin][0], chain.spans[k - 1][1]
            name, _ = _core(text[start : chain.spans[begin][1]])
            if name and _KEYS.search(name):
                start += len(name) + 1
            while start < end and text[start] in _OPEN:
                start += 1
            while start < end and text[end - 1] in _CLOSE:
                end -= 1
            if start < end and not any(a < end and start < b for _, a, b in base):
                out.append(("tagged", start, end))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, spans`` per row of ``docs`` (``doc_id, text``; other columns
    are ignored): ``kind, start, end`` (code points, end exclusive), ``base``.

    Null and empty texts have no spans; repeated rows are searched each; an
    empty table gives an empty result."""
    chosen = field or train(docs)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = [
                [{"kind": k, "start": a, "end": b, "base": k in BASE} for k, a, b in spans_of(texts[i].as_py() or "", chosen)]
                for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), search, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
