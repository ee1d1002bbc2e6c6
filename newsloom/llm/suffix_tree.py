"""Language-model scores by a probabilistic suffix tree.

Tokens are lower-cased words and an end mark per text. The base score is an
add-one model of single tokens, and the root of the tree. Every training word is
a symbol of its own, known by 64 hashed bits; words that were not learnt are one
more, which has what the base model leaves. (``share`` can restrict the symbols
to common words; nothing in the library does.)

Every context of up to ``depth`` symbols with ``least_count`` occurrences in the
training texts may become a state, so the tree grows with the corpus. It
does become one if its next-symbol distribution diverges from that of its longest
suffix in the tree by ``divergence`` nats or more, and by more than it costs to
describe. Distributions are smoothed by those of the suffix, in proportion to
the number of different successors. A text is scored from the longest suffix
that is a state at each position.

No part of the tree travels whole. Texts are numbered once and kept, on disk, in chunks of
at most about ``CHUNK_TOKENS`` tokens. Then, level by level, each chunk asks for its
different (context, next symbol), with its own training counts; questions meet by
a shuffle on a hash of the context (a cell), are added there, and the sums go back
to the chunks that asked. A context of ``CUT`` occurrences and more is dealt to
several cells by the next symbol; its sums are added afterwards, and there are
at most ``tokens / CUT`` of that kind. Two symbols after one context are
mistaken for one only if 48 bits of their hashes agree. What comes back at one level tells which
contexts are worth a question at the next.

``Tree`` and ``grow`` are the same model in one process, for a few thousand symbols.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import crc_remainder, map_rows, mix64, stage

DEPTH = 4
BITS = 13  # of a symbol of ``Tree``
END = b"\n"  # as a token; no word holds it
END_ID = 0
HELD_OUT = (7, 2)
CHUNK_TOKENS, CHUNK_WORDS = 400_000, 150_000  # a chunk ends with the text that reaches one of them
SYMBOL_BYTES = 6  # of the hash of a symbol after its context
CUT = 65_536  # occurrences of a context whose questions go to more than one cell


_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x8CB92BA72F3D8DD7)
END_HASH, OTHER = np.uint64(0), np.uint64(1)  # as symbols

CHUNK_DDL = "chunk bigint, learnt bigint, ids array<bigint>, train binary, sizes binary, known int, words binary, tokens binary"
ASK_DDL = "chunk bigint, cell int, contexts binary, lengths binary, sums binary, symbols binary, n binary"
TELL_DDL = "chunk bigint, cell int, kinds binary, n binary, context bigint, t bigint, k bigint, l double, s double"
SCORES_DDL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
CHUNK, ASK, TELL, SCORES = (
    pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, ddl.split(", "))]) for ddl in (CHUNK_DDL, ASK_DDL, TELL_DDL, SCORES_DDL))


def positions(texts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol its code, ``depth`` symbols of context (end marks before
    the text) and the symbol itself, and where each text begins."""
    pad = np.full(depth, END_ID, np.int64)
    joined = np.concatenate([x for t in texts for x in (pad, t)])
    codes = joined.copy()
    for k in range(1, depth + 1):
        codes[k:] += joined[:-k] << (BITS * k)
    lengths = np.array([len(t) + depth for t in texts])
    starts = np.cumsum(lengths) - lengths
    own = np.ones(len(joined), bool)
    own[(starts[:, None] + np.arange(depth)).ravel()] = False
    return codes[own], np.cumsum([0, *(lengths[:-1] - depth)])


def _mask(symbols: int) -> int:
    return (1 << BITS * symbols) - 1


@dataclass
class Tree:
    depth: int
    root: np.ndarray  # log10 probability of each symbol
    contexts: list[np.ndarray] = field(default_factory=list)  # by length from 1: sorted states
    missing: list[np.ndarray] = field(default_factory=list)  # log10 of the share passed to the suffix
    entries: list[np.ndarray] = field(default_factory=list)  # sorted codes of context and symbol
    values: list[np.ndarray] = field(default_factory=list)  # log10 probability

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each code after the others."""
        out, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        for d in range(len(self.contexts), 0, -1):
            states, entries = self.contexts[d - 1], self.entries[d - 1]
            if not len(states):
                continue
            context = (codes >> BITS) & _mask(d)
            at = np.minimum(np.searchsorted(states, context), len(states) - 1)
            here = open_ & (states[at] == context)
            code = codes & _mask(d + 1)
            where = np.minimum(np.searchsorted(entries, code), len(entries) - 1)
            seen = here & (entries[where] == code)
            out[seen] += self.values[d - 1][where[seen]]
            out[here & ~seen] += self.missing[d - 1][at[here & ~seen]]
            open_ &= ~seen
        out[open_] += self.root[codes[open_] & _mask(1)]
        return out


def grow(root: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], divergence: float) -> Tree:
    """``root``: probabilities of the symbols; ``levels``, from length 1: codes
    (a context and the next symbol) and counts."""
    tree = Tree(len(levels), np.log10(root))
    for codes, counts in levels:
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(float)
        if not len(codes):
            for part in (tree.contexts, tree.missing, tree.entries, tree.values):
                part.append(codes)
            continue
        states, first, of = np.unique(codes >> BITS, return_index=True, return_inverse=True)
        total, kinds = np.add.reduceat(counts, first), np.bincount(of)
        suffix = tree.log10(codes)
        gain = np.add.reduceat(counts / total[of] * (np.log(counts / total[of]) - suffix * math.log(10)), first)
        kept = (gain >= divergence) & (gain * total >= 0.5 * kinds * np.log(total + 1))
        smooth = np.log10((counts + kinds[of] * 10**suffix) / (total + kinds)[of])
        tree.contexts.append(states[kept])
        tree.missing.append(np.log10(kinds[kept] / (total + kinds)[kept]))
        tree.entries.append(codes[kept[of]])
        tree.values.append(smooth[kept[of]])
    return tree


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class Numbers(dict):
    """token -> number in a chunk, in the order of appearance; the end mark is 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words) + 1, np.uint32)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.uint32, len(words))
        return out


def _pack(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes as the largest needs, compressed if that is worth it."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    data = values.astype(kind).tobytes()
    if len(data) > 64 and len(packed := pa.compress(data, "zstd", asbytes=True)) + 4 < len(data):
        return bytes([kind.itemsize + 16]) + len(data).to_bytes(4, "little") + packed
    return bytes([kind.itemsize]) + data


def _unpack(data: bytes) -> np.ndarray:
    if data[0] < 16:
        return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)
    plain = pa.decompress(memoryview(data)[5:], int.from_bytes(data[1:5], "little"), "zstd", asbytes=True)
    return np.frombuffer(plain, f"u{data[0] - 16}").astype(np.int64)


def _pack_words(hashes: np.ndarray) -> bytes:
    """Sorted hashes: differences, byte by byte."""
    planes = np.diff(hashes, prepend=END_HASH).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack_words(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * size, "zstd", asbytes=True), np.uint8).reshape(8, size)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _cut_bytes(symbols: np.ndarray, width: int) -> bytes:
    return symbols.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _whole_bytes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins, as flags."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def chunks(docs: DataFrame) -> DataFrame:
    """Texts as numbers: ``chunk, learnt`` (number of training
    texts)``, ids, train`` (1: is one)``, sizes``
    (tokens of each text)``, known`` (number of words)``, words`` (their hashes, in
    order)``, tokens`` (numbers in that order)."""
    modulus, held = HELD_OUT
    most_tokens, most_words = CHUNK_TOKENS, CHUNK_WORDS

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, hashes = TaskContext.get().partitionId(), 0, xxhash.xxh64_intdigest
        numbers, ids, parts, total = Numbers(), [], [], 0

        def flush() -> pa.RecordBatch:
            train = np.array([crc_remainder(i, modulus) != held for i in ids], np.uint8)
            words = np.fromiter(map(hashes, numbers), np.uint64, len(numbers))
            words[0] = END_HASH
            order = np.argsort(words)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            row = [(task << 32) + made, int(train.sum()), ids, _pack(train), _pack(np.array([len(p) for p in parts])), len(words), _pack_words(words[order]), _pack(place[np.concatenate(parts)])]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, CHUNK)], schema=CHUNK)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if total >= most_tokens or len(numbers) >= most_words:
                    yield flush()
                    numbers, ids, parts, total, made = Numbers(), [], [], 0, made + 1
                ids.append(doc_id)
                parts.append(numbers.of(_words(text.as_py())))
                total += len(parts[-1])
        if ids:
            yield flush()

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), encode, CHUNK_DDL, 1024)


@dataclass
class Facts:
    """What all chunks know of the corpus."""

    cells: int
    cut: int
    tokens: int = 0
    scale: int = 1
    ends: int = 0
    listed: float = 0  # occurrences that make a word a symbol
    others: int = 0  # occurrences of all other words
    rest: float = 1.0  # probability of all other words
    least: float = 1  # occurrences that make a context a candidate
    states: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # cut ones by level: sorted, with their different successors


class Questions:
    """Different (cell, context, symbol) of a chunk, in the order of their cells."""

    def __init__(self, cell: np.ndarray, context: np.ndarray, symbol: np.ndarray):
        # Keys whose short hashes agree may be interleaved; then one comes twice, which adds up all the same.
        code = (cell.astype(np.uint64) << np.uint64(44)) | (context >> np.uint64(40) << np.uint64(20)) | ((symbol ^ context) >> np.uint64(44))
        self.order = np.argsort(code, kind="stable")
        self.cell, self.context, self.symbol = (x[self.order] for x in (cell, context, symbol))
        runs = _starts(self.cell, self.context)
        keys = runs | _starts(self.symbol)
        self.runs, self.keys = np.flatnonzero(runs), np.flatnonzero(keys)
        self.run_of, self.key_of = np.cumsum(runs) - 1, np.cumsum(keys) - 1

    def rows(self, chunk: int, train: np.ndarray, value: np.ndarray, width: int = SYMBOL_BYTES) -> pa.Table:
        """With the training occurrences of each key, and the sum of their
        ``value`` for each context."""
        columns: list[list] = [[] for _ in ASK]
        if len(self.order):
            n = np.add.reduceat(train[self.order].astype(np.int64), self.keys)
            s = np.add.reduceat((train * value)[self.order], self.runs)
            lengths = np.bincount(self.run_of[self.keys], minlength=len(self.runs))
            context, symbol = self.context[self.runs], self.symbol[self.keys]
            first = np.flatnonzero(_starts(self.cell))
            run_at, key_at = (np.append(of[first], size) for of, size in ((self.run_of, len(self.runs)), (self.key_of, len(self.keys))))
            for k, cell in enumerate(self.cell[first].tolist()):
                r, q = slice(run_at[k], run_at[k + 1]), slice(key_at[k], key_at[k + 1])
                row = (chunk, cell, context[r].tobytes(), _pack(lengths[r]), s[r].tobytes(), _cut_bytes(symbol[q], width), _pack(n[q]))
                for column, v in zip(columns, row):
                    column.append(v)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ASK)], schema=ASK)

    def answers(self, told: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Different successors of the context (0: no state) and occurrences of the key, by position."""
        told = sorted(told)
        kinds, n = (np.concatenate([np.empty(0, np.int64), *[_unpack(t[k]) for t in told]]) for k in (1, 2))
        out = np.empty((2, len(self.order)), np.int64)
        out[0][self.order], out[1][self.order] = kinds[self.run_of], n[self.key_of]
        return out[0], out[1]


class Chunk:
    """The texts of a chunk and what is known of their tokens so far."""

    def __init__(self, row: dict, depth: int):
        self.number, self.ids = row["chunk"], row["ids"]
        self.words, self.tokens, self.sizes = _unpack_words(row["words"], row["known"]), _unpack(row["tokens"]), _unpack(row["sizes"])
        self.learnt = _unpack(row["train"]).astype(bool)
        self.train = np.repeat(self.learnt, self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.at = np.arange(len(self.tokens)) + depth * (np.repeat(np.arange(len(self.sizes)), self.sizes) + 1)
        self.padded = np.zeros(len(self.tokens) + depth * len(self.sizes), np.int64)  # end marks before each text
        self.padded[self.at] = self.tokens

    def first(self, cells: int) -> Questions:
        """Questions for the occurrences of the words."""
        return Questions((self.words % np.uint64(cells)).astype(np.int64) + cells, np.zeros(len(self.words), np.uint64), self.words)

    def climb(self, facts: Facts, told: dict[int, list], level: int, wave: int = 0, waves: int = 1) -> tuple[Questions, np.ndarray] | None:
        """Up to the questions of ``level``, to the cells of a wave, and the tokens
        they are for; none if there are answers to these too."""
        self.counts = self.first(facts.cells).answers(told[0])[1]
        listed = (self.counts > 0) & (self.counts >= facts.listed)
        listed[0] = True
        symbols = np.where(listed, self.words, OTHER)[self.padded]
        self.root = np.where(listed, (self.counts + 1) / facts.scale, facts.rest)[self.tokens]
        self.value = self.root.copy()  # probability from the longest suffix so far
        before = np.where(listed, self.counts, facts.others)[self.padded]
        context = np.zeros(len(self.at), np.uint64)
        for d in range(1, level + 1):
            # A context occurs as often as its last symbol after the others.
            total = before[self.at - 1]
            context = mix64(context * _A + symbols[self.at - d] + _C)
            here = np.flatnonzero(total >= facts.least)
            c, x, t = context[here], symbols[self.at[here]], total[here]
            cell, cut = (c % np.uint64(facts.cells)).astype(np.int64), np.flatnonzero(t > facts.cut)
            pieces = np.ceil(2 * t[cut] / facts.cut).astype(np.uint64)
            cell[cut] = (mix64(c[cut] + _C * (x[cut] % pieces)) % np.uint64(facts.cells)).astype(np.int64) + facts.cells
            if d not in told and d == level:
                mine = np.flatnonzero(cell % waves == wave)
                return Questions(cell[mine], c[mine], x[mine]), here[mine]
            asked = Questions(cell, c, x)
            kinds, n = asked.answers(told.get(d, []))
            known, theirs = facts.states[d - 1]
            if len(known):
                spot = np.minimum(np.searchsorted(known, c[cut]), len(known) - 1)
                kinds[cut] = np.where(known[spot] == c[cut], theirs[spot], 0)
            state = kinds > 0
            on, k = here[state], kinds[state]
            self.value[on] = (n[state] + k * self.value[on]) / (t[state] + k)
            before = np.full(len(self.padded), facts.ends)
            before[self.at] = 0
            before[self.at[here]] = n
        return None

    def scores(self, facts: Facts) -> pa.Table:
        def of_text(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, self.starts)

        base = of_text(np.log10((self.counts + 1) / facts.scale)[self.tokens])
        columns = [self.ids, ~self.learnt, self.sizes, of_text((self.counts > 0)[self.tokens].astype(np.int64)), base, base + of_text(np.log10(self.value / self.root))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCORES)], schema=SCORES)


def _diverges(t: np.ndarray, k: np.ndarray, l: np.ndarray, s: np.ndarray, divergence: float) -> np.ndarray:
    """Of contexts with ``t`` occurrences and ``k`` different successors; ``l``:
    sum of n ln n over these, ``s``: sum of log10 of the suffix's probability
    over the occurrences."""
    gain = (l - s * math.log(10)) / t - np.log(t)
    return (gain >= divergence) & (gain * t >= 0.5 * k * np.log(t + 1))


def answered(asked: DataFrame, level: int, cells: int, divergence: float) -> DataFrame:
    """Staged answers by ``chunk, cell``: different successors of each context
    (0: no state) and occurrences of each key. Rows without a chunk are sums of a
    cut context; at level 0, how many words (``k``) have ``context`` occurrences."""

    def meet(rows: pa.Table) -> pa.Table:
        of = {name: rows.column(name).to_pylist() for name in ("chunk", "cell", "contexts", "lengths", "sums", "symbols", "n")}
        cut = of["cell"][0] >= cells
        contexts, sums = (np.concatenate([np.frombuffer(b, kind) for b in of[name]]) for name, kind in (("contexts", np.uint64), ("sums", float)))
        symbols = np.concatenate([_whole_bytes(b, SYMBOL_BYTES if level else 8) for b in of["symbols"]])
        lengths, n = [_unpack(b) for b in of["lengths"]], [_unpack(b) for b in of["n"]]
        known, spot = np.unique(contexts, return_inverse=True)
        by = np.repeat(spot, np.concatenate(lengths))
        if level and len(known) < 1 << 64 - 8 * SYMBOL_BYTES:  # both fit in 64 bits
            order = np.argsort(by.astype(np.uint64) << np.uint64(8 * SYMBOL_BYTES) | symbols)
        else:
            order = np.lexsort((symbols, by))
        new = _starts(by[order], symbols[order])
        key = np.empty(len(order), np.int64)
        key[order] = np.cumsum(new) - 1
        total = np.add.reduceat(np.concatenate(n)[order], np.flatnonzero(new))
        first = np.flatnonzero(_starts(by[order][new]))
        t, k, l = (np.add.reduceat(v, first) for v in (total, (total > 0).astype(np.int64), total * np.log(np.maximum(total, 1))))
        s = np.bincount(spot, weights=sums, minlength=len(known))
        kinds = np.zeros(len(known), np.int64) if cut else np.where(_diverges(t, k, l, s, divergence), k, 0)
        kinds, total = kinds[spot], total[key]
        ends = [np.cumsum([len(p) // 8 for p in of["contexts"]]), np.cumsum([len(p) for p in n])]
        told = [[_pack(p) for p in np.split(v, e[:-1])] for v, e in zip((kinds, total), ends)]
        out = [of["chunk"], of["cell"], *told, *[[None] * len(n)] * 5]
        if cut and level == 0:
            size, words = np.unique(total[np.unique(key, return_index=True)[1]], return_counts=True)
            more = [size.tolist(), (size * words).tolist(), words.tolist(), [0.0] * len(size), [0.0] * len(size)]
        elif cut:
            more = [known.view(np.int64).tolist(), t.tolist(), k.tolist(), l.tolist(), s.tolist()]
        else:
            more = [[]] * 5
        out = [a + b for a, b in zip(out, [*[[None] * len(more[0])] * 4, *more])]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, TELL)], schema=TELL)

    return stage(asked.groupBy("cell").applyInArrow(meet, TELL_DDL), f"lm-level-{level}")


def score(
    docs: DataFrame, known_words: int | None = None, depth: int = DEPTH, share: float = 0.0, least: float = 0.0, least_count: int = 20, divergence: float = 0.02,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    per row of ``docs`` (``doc_id, text``; other columns are ignored).

    Null, empty and blank texts are the end mark alone. Repeated rows are
    learnt from and scored each. Without training texts all counts are 0 and
    every token has probability 1. An empty table gives an empty result.
    ``known_words`` has no effect: all counts are joined."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = chunks(docs).repartition(parts, "chunk").persist(StorageLevel.DISK_ONLY)  # each level meets them where they are
    sums = texts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.length("tokens"), F.col("learnt"))]).first()
    cells, ends, told = min(1 << 18, max(8, sums[0] // 1_000_000)), sums[1], []

    def ask(level: int, facts: Facts, wave: int = 0, waves: int = 1) -> DataFrame:
        carried = spark.sparkContext.broadcast(facts)

        def words(rows: pa.Table) -> pa.Table:
            chunk = Chunk(rows.to_pylist()[0], depth)
            learnt = np.bincount(chunk.tokens[chunk.train], minlength=len(chunk.words))
            return chunk.first(cells).rows(chunk.number, learnt, np.zeros(len(learnt)), 8)

        def contexts(rows: pa.Table, answers: pa.Table) -> pa.Table:
            chunk = Chunk(rows.to_pylist()[0], depth)
            asked, here = chunk.climb(carried.value, _by_level(answers), level, wave, waves)
            return asked.rows(chunk.number, chunk.train[here], np.log10(chunk.value[here]))

        if level == 0:
            asked = texts.groupBy("chunk").applyInArrow(words, ASK_DDL)
        else:
            asked = texts.groupBy("chunk").cogroup(_back(told).groupBy("chunk")).applyInArrow(contexts, ASK_DDL)
        return answered(asked, level, cells, divergence)

    told.append(ask(0, Facts(cells, CUT)))
    many = told[0].where("chunk IS NULL").groupBy(F.col("context").alias("n")).agg(F.sum("k").alias("k")).where("n > 0")
    sums = many.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(a) for v, a in ((F.col("n") * F.col("k"), "n"), (F.col("k"), "v"))]).first()
    tokens, scale, bound = sums["n"], sums["n"] + sums["v"] + 1, share * sums["n"]
    listed = many.where(F.col("n") >= bound).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(a) for v, a in ((F.col("n") * F.col("k"), "n"), (F.col("k"), "v"))]).first()
    here, kinds = (listed["n"], listed["v"]) if ends >= bound and ends else (listed["n"] + ends, listed["v"] + 1)
    facts = Facts(cells, CUT, tokens, scale, ends, bound, tokens - here, max(1 - (here + kinds) / scale, 1 / scale), max(least * tokens, least_count, 1))
    for level in range(1, depth + 1):
        waves = 2 if level <= 2 else 1  # most keys: not all at once on disk
        told.append(reduce(DataFrame.unionByName, [ask(level, facts, k, waves) for k in range(waves)]))
        # At most tokens / CUT contexts are cut.
        rows = told[level].where("chunk IS NULL").groupBy("context").agg(*[F.sum(c).alias(c) for c in ("t", "k", "l", "s")]).toArrow()
        c, t, k, l, s = (rows[name].to_numpy() for name in ("context", "t", "k", "l", "s"))
        kept = _diverges(t, k, l, s, divergence)
        c, k = c[kept].astype(np.int64).view(np.uint64), k[kept].astype(np.int64)
        order = np.argsort(c)
        facts = replace(facts, states=[*facts.states, (c[order], k[order])])
    carried = spark.sparkContext.broadcast(facts)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(rows.to_pylist()[0], depth)
        chunk.climb(carried.value, {d: [] for d in range(depth + 1)} | _by_level(answers), depth)
        return chunk.scores(carried.value)

    out = stage(texts.groupBy("chunk").cogroup(_back(told).groupBy("chunk")).applyInArrow(finish, SCORES_DDL), "lm-scores")
    texts.unpersist()
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _back(told: list[DataFrame]) -> DataFrame:
    """All answers, to go back to the chunks."""
    return reduce(DataFrame.unionByName, [rows.where("chunk IS NOT NULL").select("chunk", F.lit(d).alias("level"), "cell", "kinds", "n") for d, rows in enumerate(told)])


def _by_level(answers: pa.Table) -> dict[int, list[tuple[int, bytes, bytes]]]:
    out: dict[int, list] = {}
    for level, *told in zip(*[answers.column(c).to_pylist() for c in ("level", "cell", "kinds", "n")]):
        out.setdefault(level, []).append(tuple(told))
    return out
