"""Phrases whose words stand together more often than by chance, by stripes.

A stripe is a prefix (of zero to four words) with an associative counter of the
words that follow it. A task builds the stripes of its texts and merges them;
equal stripes of all tasks meet by a shuffle on the prefix and are merged entry by
entry. Level ``k`` has the phrases of ``k`` words, as entries of the stripes of
their prefixes, with exact counts. From a level come its extensions (entries of at
least ``least`` occurrences), the totals of its prefixes (the level before) and the
largest count under a prefix, or under all words but the first, which decides
whether a longer phrase makes a shorter one superfluous.

A phrase can be frequent only if its first and last ``k - 1`` words are. What is
frequent at the level before reaches the tasks as a table of ``SLOTS`` bytes,
whatever the corpus: per hash the logarithm of the largest count. Hashes that meet
there only let more candidates through. The same byte says into how many buckets
of next words a prefix's stripe is cut, so the stripe of a very common word is
spread over tasks. The stripes of a task travel together by cell, a hash of prefix
and bucket: no row is larger than what a task holds.

Single words are counted as they are. Longer phrases travel as numbers: a prefix
(with its language) as 128 hashed bits, the word after it as 64; frequent ones get
their words back by joins with the level before and with the words. Two phrases
are mistaken for one only if all 192 bits agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_rows, mix64, stage
from newsloom.operators.scale import checked_broadcast, top_per_group

LONGEST = 5
LEAST = 100
TOP = 2000
SLOTS = 1 << 22
WORD_BUCKETS = 4096  # of the empty prefix
STRIPE_BITS = 16  # a prefix with more occurrences is cut
CELLS = 4096  # at least; what a task has for a cell travels as one row
ENTRIES = 2_000_000  # counters a task holds before it hands them on
VOCABULARY = 400_000  # words a task numbers before it starts anew
BYTES = 3_000_000  # of text taken at once; a longer text is taken alone

BREAK, TEXT = b"\xff", b"\xfe"  # in no UTF-8 text: between pieces, before a text
_MARKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _MARKS, b"abcdefghijklmnopqrstuvwxyz" + BREAK * len(_MARKS))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)

STRIPES = "cell int, p1 array<bigint>, p2 array<bigint>, next array<bigint>, n array<bigint>"
WORD_STRIPES = "lang string, bucket int, next array<string>, n array<bigint>"


class Words(dict):
    """word (bytes) -> number, with the words and their hashes by number; the
    breaks come first."""

    def __init__(self):
        super().__init__()
        self.list, self.hashes = [], []
        self._known = np.empty(0, np.uint64)
        self[BREAK], self[TEXT]

    def hashed(self) -> np.ndarray:
        """Hashes by number; only new ones are converted."""
        if len(self._known) < len(self.hashes):
            self._known = np.append(self._known, np.array(self.hashes[len(self._known) :], np.uint64))
        return self._known

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.list)
        self.list.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], bytes]]:
    """Languages and folded texts, joined, a bounded amount at a time."""
    langs, parts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            data = (text.as_py() or "").encode()
            if parts and size + len(data) > BYTES:
                yield langs, b"".join(parts)
                langs, parts, size = [], [], 0
            langs.append("und" if (name := lang.as_py()) is None else name)
            parts.append(b" \xfe " + data.translate(_FOLD).replace(BREAK, b" \xff "))
            size += len(data)
    if parts:
        yield langs, b"".join(parts)


def _numbers(data: bytes, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers, and the number of the text each belongs to."""
    split = data.split()
    ids = np.fromiter(map(words.__getitem__, split), np.int64, len(split))
    return ids, np.cumsum(ids == 1) - 1


def _second(c: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix64(c * _B + mix64(h + _C))


def _first(c: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix64(c * _A + h)


def _lang_hash(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the (sorted) keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _lists(starts: np.ndarray, columns: list[np.ndarray], lists: list[pa.Array], names: list[str], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """A row per start, with the entries up to the next one."""
    ends = np.append(starts, len(lists[0]))
    for i in range(0, len(starts), rows):
        part = ends[i : i + rows + 1]
        offsets = pa.array((part - part[0]).astype(np.int32))
        inside = [pa.ListArray.from_arrays(offsets, x.slice(part[0], part[-1] - part[0])) for x in lists]
        yield pa.RecordBatch.from_arrays([*[pa.array(c[part[:-1]]) for c in columns], *inside], names=names)


def word_stripes(docs: DataFrame) -> DataFrame:
    """Stripes of the empty prefix, one of each bucket and language a task, and in
    bucket -1 the number of all words of the language."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, langs, parts, entries = Words(), {}, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal entries
            if parts:
                code, n = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(code, kind="stable")
                runs = _runs(code[order])
                code, n = code[order][runs], np.add.reduceat(n[order], runs)
                lang, word = code >> 40, code & ((1 << 40) - 1)
                bucket = np.where(word == 0, -1, (words.hashed()[word] % np.uint64(WORD_BUCKETS)).astype(np.int64))
                order = np.lexsort((bucket, lang))
                lang, word, bucket, n = lang[order], word[order], bucket[order], n[order]
                names = np.array(list(langs), object)
                spelt = pa.array([words.list[w] if w else b"" for w in word.tolist()], pa.binary()).cast(pa.string())
                yield from _lists(_runs(lang, bucket), [names[lang], bucket.astype(np.int32)], [spelt, pa.array(n)], ["lang", "bucket", "next", "n"])
            parts.clear()
            entries = 0

        for names, data in _texts(batches):
            ids, text = _numbers(data, words)
            own = ids > 1
            lang = np.array([langs.setdefault(x, len(langs)) for x in names], np.int64)[text[own]]
            for code in ((lang << 40) | ids[own], lang << 40):  # words, and their number as word 0
                kinds, n = np.unique(code, return_counts=True)
                parts.append((kinds, n))
                entries += len(kinds)
            if entries > ENTRIES or len(words) > VOCABULARY:
                yield from flush()
                if len(words) > VOCABULARY:
                    words = Words()
        yield from flush()

    return map_rows(docs.select("lang", "text"), build, WORD_STRIPES, 1024)


def stripes(docs: DataFrame, k: int, sizes: np.ndarray) -> DataFrame:
    """Stripes of the phrases of ``k`` words, at least two, by cell; one or several
    rows a task and cell, with the stripes' entries in the order of their prefixes."""
    cells = max(CELLS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, entries = Words(), [], 0

        def merge() -> None:
            p1, p2, after, size, n = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(_first(p1, after))  # equal entries meet; what else has this hash stays apart
            p1, p2, after = p1[order], p2[order], after[order]
            runs = _runs(p1, p2, after)
            parts[:] = [(p1[runs], p2[runs], after[runs], size[order][runs], np.add.reduceat(n[order], runs))]

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                merge()
                p1, p2, after, size, n = parts.pop()
                cut = np.uint64(1) << np.maximum(0, size.astype(np.int64) - 1 - STRIPE_BITS).astype(np.uint64)
                cell = (mix64(p1 + _C * (mix64(after) % cut)) % np.uint64(cells)).astype(np.int32)
                order = np.lexsort((p1, cell))
                cell = cell[order]
                columns = [pa.array(x[order].view(np.int64)) for x in (p1, p2, after, n)]
                yield from _lists(_runs(cell), [cell], columns, ["cell", "p1", "p2", "next", "n"], 512)

        mask = np.uint64(len(sizes) - 1)
        for names, data in _texts(batches):
            ids, text = _numbers(data, words)
            if len(ids) < k:
                continue
            h, lang = words.hashed()[ids], _lang_hash(names)[text]
            width = len(ids) - k + 2
            c = lang[:width]
            for j in range(k - 1):
                c = _first(c, h[j : j + width])
            known = sizes[(c & mask).astype(np.int64)]
            breaks = np.cumsum(np.append(0, ids < 2))
            at = np.flatnonzero((breaks[k:] == breaks[:-k]) & (known[:-1] > 0) & (known[1:] > 0))
            if len(at):
                p1, p2, after = c[at], mix64(lang[at] + _C), h[at + k - 1]
                for j in range(k - 1):
                    p2 = _second(p2, h[at + j])
                order = np.argsort(_first(p1, after))
                p1, p2, after = p1[order], p2[order], after[order]
                runs = _runs(p1, p2, after)
                parts.append((p1[runs], p2[runs], after[runs], known[at][order][runs], np.diff(np.append(runs, len(at)))))
                entries += len(runs)
            if entries > ENTRIES:
                merge()
                entries = len(parts[0][0])
                if entries > ENTRIES // 2:
                    yield from flush()
                    entries = 0
            if len(words) > VOCABULARY:
                words = Words()
        yield from flush()

    return map_rows(docs.select("lang", "text"), build, STRIPES, 1024)


def merged_words(parts: DataFrame) -> DataFrame:
    """Word stripes added entry by entry: ``lang, bucket, next, n``."""
    entries = parts.repartition("lang", "bucket").select("lang", "bucket", F.inline(F.arrays_zip("next", "n")))
    return entries.groupBy("lang", "bucket", "next").agg(F.sum("n").alias("n"))  # stays where the stripes are


def merged(parts: DataFrame) -> DataFrame:
    """Stripes added entry by entry: ``p1, p2, next, n``."""
    entries = parts.repartition("cell").select("cell", F.inline(F.arrays_zip("p1", "p2", "next", "n")))
    return entries.groupBy("cell", "p1", "p2", "next").agg(F.sum("n").alias("n")).drop("cell")


def _numbered(level: DataFrame, first: bool, slots: int) -> DataFrame:
    """With ``next`` as a number, the hash ``id1, id2`` of the phrase, and its slot."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if first:
                c1 = _lang_hash(batch.column("lang").to_pylist())
                c2, h = mix64(c1 + _C), np.array([xxhash.xxh64_intdigest(x.encode()) for x in batch.column("phrase").to_pylist()], np.uint64)
            else:
                c1, c2, h = (batch.column(x).to_numpy().view(np.uint64) for x in ("p1", "p2", "next"))
            id1, id2 = _first(c1, h), _second(c2, h)
            found = [h.view(np.int64), id1.view(np.int64), id2.view(np.int64), (id1 & np.uint64(slots - 1)).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(x) for x in ("lang", "prefix", "phrase", "n")], *map(pa.array, found)], names=["lang", "prefix", "phrase", "n", "h", "id1", "id2", "slot"])

    return map_rows(level, number, "lang string, prefix string, phrase string, n bigint, h bigint, id1 bigint, id2 bigint, slot int", 2048)


def size_table(level: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """One byte a slot: 0, or 1 plus the binary logarithm of the largest count of a
    phrase that hashes there."""
    size = F.length(F.bin("n")).cast("int")
    rows = level.groupBy("slot").agg(F.max(size).alias("size")).toArrow()  # at most ``slots`` rows
    table = np.zeros(slots, np.uint8)
    table[rows["slot"].to_numpy()] = rows["size"].to_numpy()
    return table


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, slots: int = SLOTS) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, n`` with the number of words, and for one to ``longest`` words the
    staged frequent phrases ``lang, prefix, phrase, n`` (and their numbers)."""
    counts = stage(merged_words(word_stripes(docs)).where((F.col("n") >= least) | (F.col("bucket") < 0)), "phrases-words")
    totals = counts.where(F.col("bucket") < 0).select("lang", "n")
    words = counts.where((F.col("bucket") >= 0) & (F.col("n") >= least)).select("lang", F.lit("").alias("prefix"), F.col("next").alias("phrase"), "n")
    found = [stage(_numbered(words, True, slots), "phrases-1")]
    spelt = found[0].select("lang", F.col("h").alias("next"), F.col("phrase").alias("word"))
    for k in range(2, longest + 1):
        frequent = merged(stripes(docs, k, size_table(found[-1], slots))).where(F.col("n") >= least)
        prefixes = found[-1].select(F.col("id1").alias("p1"), F.col("id2").alias("p2"), "lang", F.col("phrase").alias("prefix"))
        level = frequent.join(prefixes, ["p1", "p2"]).join(spelt, ["lang", "next"])
        shown = level.select("lang", "prefix", F.concat_ws(" ", "prefix", "word").alias("phrase"), "n", "p1", "p2", "next")
        found.append(stage(_numbered(shown, False, slots), f"phrases-{k}"))
    return totals, found


def _rest(phrase: str) -> Column:
    """All words but the first."""
    return F.substring(F.col(phrase), F.instr(phrase, " ") + 1, F.length(phrase))


def whole_phrases(found: list[DataFrame]) -> DataFrame:
    """``lang, phrase, words, a``: phrases of two words and more that no longer one
    has as often. It is enough to look at one word more: a phrase between two has
    the same count. A stripe's largest count settles the prefix, the same over
    the phrases without their first word settles the rest."""
    longer = [level.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("n").alias("most")) for level in found[2:]]
    longer += [level.groupBy("lang", _rest("phrase").alias("phrase")).agg(F.max("n").alias("most")) for level in found[2:]]
    mine = reduce(DataFrame.unionByName, [level.select("lang", "phrase", F.lit(k).alias("words"), F.col("n").alias("a")) for k, level in enumerate(found[1:], 2)])
    if not longer:
        return mine
    most = reduce(DataFrame.unionByName, longer).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    return mine.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < 100 * F.col("a"))).drop("most")


def collocations(docs: DataFrame, top: int | None = TOP, longest: int = LONGEST, least: int = LEAST, slots: int = SLOTS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the phrases of ``docs`` (``lang,
    text``; other columns are ignored), per language the first ``top`` by score.

    A null language is ``und``, an empty one stays what it is; null and empty texts
    have no words. Repeated rows count each, whole texts are read. Arithmetic is
    exact (38 digits). Languages without a phrase have no rows; an empty table
    gives an empty result."""
    totals, found = levels(docs, longest, least, slots)
    counts = reduce(DataFrame.unionByName, [level.select("lang", "phrase", "n") for level in found])
    cuts = whole_phrases(found).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    for side, name in (("left", "l"), ("right", "r")):
        sides = sides.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    exact = {x: F.col(x).cast("decimal(19,0)") for x in ("a", "n", "l", "r")}
    scored = sides.join(checked_broadcast(totals), "lang").withColumn("up", exact["a"] * exact["n"] * 1000).withColumn("down", exact["l"] * exact["r"])
    lowest = scored.withColumn("score", F.expr("up div down")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    facts = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = top_per_group(facts, ["lang"], order, top if top is not None else 2**31 - 1)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same by plain counting, for the whole table.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sized AS (SELECT lang, w, k.k FROM split, (SELECT unnest(range(1, 6)) AS k) k WHERE len(w) >= k.k),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, n AS a FROM f WHERE k >= 2 AND n >= 100),
whole AS (SELECT * FROM cand c WHERE NOT EXISTS (
  SELECT 1 FROM cand o WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.a >= 100 * c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS x, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS y
  FROM (SELECT lang, phrase, a, unnest(range(1, k)) AS c FROM whole)),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, cuts.c, l.n AS l, r.n AS r, t.n AS n,
    ((1000::HUGEINT * cuts.a * t.n) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = cuts.x JOIN f r ON r.lang = cuts.lang AND r.phrase = cuts.y
  JOIN totals t ON t.lang = cuts.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest
QUALIFY rank <= 2000
"""
