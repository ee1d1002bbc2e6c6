"""Quality classifier: a factorisation machine.

A document is a sparse vector of hashed words (sublinear counts, unit length),
one indicator per structure statistic (its value falls into a fixed bin) and
one for the recorded length. The machine adds a bias, a weight per feature and
an interaction of low rank for every pair of features. Pairs are never formed:
the sum over pairs is half the squared sum less the sum of squares, per factor,
which is linear in the number of features.

Features are computed on the executors for training and for scoring by the same
function. Training takes at most ``max_rows`` labelled rows, chosen by a hash of
the id; the model has a fixed size and travels with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Buffer, WordHashes, id_remainder, map_rows, rows

WORD_BITS = 14
_GEOMETRIC = np.array([0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9])
#: Bin edges of the structure statistics, in the order of ``_statistics``.
EDGES = (
    np.array([1, 5, 10, 20, 40, 80, 160, 320, 640, 1280, 5120]),  # words
    np.array([1, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 14, 20]),  # bytes per word
    np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),  # distinct words
    _GEOMETRIC,  # words equal to the one before
    _GEOMETRIC,  # pairs of words seen before
    _GEOMETRIC,  # share of the most frequent word
    _GEOMETRIC,  # symbols per word
    _GEOMETRIC,  # exclamation and question marks per word
    _GEOMETRIC,  # bars per word
    _GEOMETRIC,  # capitals per byte
    _GEOMETRIC,  # digits per byte
    _GEOMETRIC,  # lines per word
    _GEOMETRIC,  # lines seen before
    np.array([0, 1, 8, 32, 128, 512, 1024, 2048, 4096, 16384, 65536]),  # recorded length
)
_STARTS = np.cumsum([1 << WORD_BITS, *[len(e) + 1 for e in EDGES]])
WIDTH = int(_STARTS[-1])

_KIND = np.zeros(256, np.uint8)
for _kind, _characters in enumerate((b"#*$%&<>", b"!?", b"|", bytes(range(65, 91)), bytes(range(48, 58)), b"\n"), 1):
    _KIND[list(_characters)] = _kind


class Features:
    """text -> (indices, values)."""

    def __init__(self):
        self._hashes = WordHashes()

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        data = (text or "").encode()
        words = self._hashes.of(data.lower().split())
        distinct, counts = np.unique(words, return_counts=True)
        kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7)
        lines = [x for x in data.split(b"\n") if not x.isspace() and x]
        n, size, n_lines = max(len(words), 1), max(len(data), 1), max(len(lines), 1)
        pairs = words[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-1]
        statistics = (
            len(words), size / n, len(distinct) / n, np.count_nonzero(words[1:] == words[:-1]) / n,
            1 - len(np.unique(pairs)) / max(len(pairs), 1), counts.max(initial=0) / n, kinds[1] / n, kinds[2] / n, kinds[3] / n,
            kinds[4] / size, kinds[5] / size, kinds[6] / n, 1 - len(set(lines)) / n_lines if lines else 0.0,
            -1 if n_chars is None else n_chars,
        )
        shown = [int(start) + int(np.searchsorted(edges, x, "right")) for start, edges, x in zip(_STARTS, EDGES, statistics)]
        slots, where = np.unique((distinct >> np.uint64(64 - WORD_BITS)).astype(np.int32), return_inverse=True)
        weights = np.bincount(where, 1 + np.log(counts), len(slots)) if len(slots) else np.empty(0)
        weights /= max(np.sqrt((weights**2).sum()), 1e-9)
        return np.concatenate([slots, np.array(shown, np.int32)]), np.concatenate([weights, np.ones(len(shown))]).astype(np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # WIDTH
    factors: np.ndarray  # WIDTH x rank

    def margin(self, indices: np.ndarray, values: np.ndarray) -> float:
        spread = self.factors[indices] * values[:, None]
        pairs = 0.5 * float((spread.sum(0) ** 2 - (spread**2).sum(0)).sum())
        return self.bias + float(self.linear[indices] @ values) + pairs

    def score(self, indices: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(indices, values), -30, 30))))


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], rank: int = 6, epochs: int = 12, steps: int = 600, rate: float = 0.1, decay: float = 1e-4, seed: int = 6) -> Machine:
    """Logistic loss, adaptive steps, small batches; classes weigh alike up to
    a factor of three. Few examples are passed over more often, for ``steps``
    batches in all. Without examples the machine answers 0.5."""
    random = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(WIDTH), random.normal(0, 0.02, (WIDTH, rank)))
    if not examples:
        return model
    labels = np.array([y for y, _, _ in examples], float)
    ones = labels.mean()
    model.bias = float(np.log((ones * len(labels) + 1) / ((1 - ones) * len(labels) + 1)))
    rare = min(3.0, max(ones, 1 - ones) / max(min(ones, 1 - ones), 1e-6))
    cost = np.where(labels == (ones < 0.5), rare, 1.0)
    seen_linear, seen_factors, seen_bias = np.full(WIDTH, 1e-3), np.full((WIDTH, rank), 1e-3), 1e-3
    for _ in range(max(epochs, -(-64 * steps // len(examples)))):
        order = random.permutation(len(examples))
        for begin in range(0, len(order), 64):
            chosen = order[begin : begin + 64]
            lengths = np.array([len(examples[i][1]) for i in chosen])
            indices = np.concatenate([examples[i][1] for i in chosen])
            values = np.concatenate([examples[i][2] for i in chosen])[:, None].astype(float)
            row = np.repeat(np.arange(len(chosen)), lengths)
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            spread = model.factors[indices] * values
            sums = np.add.reduceat(spread, first)
            margin = model.bias + np.add.reduceat(model.linear[indices] * values[:, 0], first) + 0.5 * (sums**2 - np.add.reduceat(spread**2, first)).sum(1)
            slope = cost[chosen] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) / len(chosen)
            touched, back = np.unique(indices, return_inverse=True)
            pull = slope[row][:, None] * values
            d_linear = np.bincount(back, pull[:, 0], len(touched)) + decay * model.linear[touched]
            steps = pull * (sums[row] - spread)
            d_factors = np.stack([np.bincount(back, steps[:, f], len(touched)) for f in range(rank)], 1) + decay * model.factors[touched]
            seen_linear[touched] += d_linear**2
            seen_factors[touched] += d_factors**2
            model.linear[touched] -= rate * d_linear / np.sqrt(seen_linear[touched])
            model.factors[touched] -= 0.5 * rate * d_factors / np.sqrt(seen_factors[touched])
            seen_bias += slope.sum() ** 2
            model.bias -= rate * slope.sum() / seen_bias**0.5
    return model


def _input(docs: DataFrame) -> list[Column]:
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return [F.col("text"), length.alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, **settings) -> Machine:
    """Fit on labelled rows outside the held-out fifth, ``max_rows`` at most.
    A document labelled more than once counts as good only if all say so; of
    rows with the same id the first by text and length is learnt from, so that
    none takes the place of another."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (id_remainder(5) != 0))
        .groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("__label"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # so the broadcast is bounded
    sample = docs.select("doc_id", *_input(docs)).join(F.broadcast(chosen), "doc_id")
    one = sample.groupBy("doc_id").agg(F.min("__label").alias("__label"), F.min(F.struct("text", "n_chars")).alias("row")).select("__label", "row.*")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        out = Buffer(pa.schema([("label", pa.int32()), ("indices", pa.binary()), ("vals", pa.binary())]))
        for label, text, n_chars in rows(batches, "__label", "text", "n_chars"):
            indices, values = of(text, n_chars)
            out.add(label, indices.tobytes(), values.tobytes(), weight=8 * len(indices))
            if out.full():
                yield out.take()
        yield out.take()

    taken = map_rows(one, features, "label int, indices binary, vals binary").collect()
    # Rows come in no fixed order; sorting them makes reruns agree.
    taken = sorted((r["label"], bytes(r["indices"]), bytes(r["vals"])) for r in taken)
    return fit([(min(1, y), np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for y, i, v in taken], **settings)


def score(docs: DataFrame, model: Machine, keep: list[str]) -> DataFrame:
    """A struct ``row`` of the columns ``keep`` and ``score``, per row of ``docs``."""
    carried = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.struct(*_input(docs)).alias("read"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in batches:
            texts, lengths = batch.column("read").field("text"), batch.column("read").field("n_chars")
            values = [model.score(*of(texts[i].as_py(), lengths[i].as_py())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(values, pa.float64())], names=["row", "score"])

    return map_rows(carried, scored, f"row {docs.select(*keep).schema.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    Null and empty texts have no words but are scored by their structure;
    repeated rows are scored each; an empty table gives an empty result; null
    ids and null labels teach nothing."""
    scored = score(docs, train(docs, labels, **settings), ["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with the columns of ``docs``."""
    return score(docs, train(docs, labels, **settings), docs.columns).where(F.col("score") >= threshold).select("row.*")
