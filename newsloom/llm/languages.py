"""Language of a text by rank-order profiles of character n-grams.

A text is lower-cased; runs of anything but letters become one blank, and
n-grams of one to three characters are counted. A profile lists the most
frequent n-grams in order. The distance of a text from a language is the sum,
over the n-grams of the text's profile, of how far each is out of place in the
language's profile; one that is missing counts the profile's length.

Counts of all training texts are summed in the tasks, then per language and
n-gram; the first ``size`` of each language are found by a rank that Spark limits
in every map task. A block of at most ``BLOCK`` languages travels with the tasks,
so what is shipped is bounded by ``BLOCK * size`` numbers; texts pass one block
after the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import crc_remainder, id_remainder, map_rows, stage
from newsloom.operators.scale import top_per_group

HELD_OUT = (3, 1)
SIZE = 400
BLOCK = 256
UNKNOWN = "und"
MEMORY = 1_000_000  # n-grams a task holds before it hands them on
PLANES = 0x110000


def _letters() -> np.ndarray:
    """For every code point its lower-case form if it is a letter, else 0."""
    table = np.zeros(PLANES, np.uint32)
    for code in range(PLANES):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """Lower-case letters as code points, with one 0 around and between words;
    empty if there is no letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    codes = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not codes.any():
        return codes[:0]
    padded = np.concatenate([[np.uint32(0)], codes, [np.uint32(0)]])
    return padded[(padded != 0) | np.append(True, padded[:-1] != 0)]


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of the whole text: 21 bits a character, the last one
    lowest; a blank is 1, so that codes of unequal length differ. A blank alone
    is no n-gram."""
    s = np.maximum(symbols(text).astype(np.int64), 1)
    if not len(s):
        return s
    two = (s[:-1] << 21) | s[1:]
    return np.concatenate([s[s != 1], two, (two[:-1] << 21) | s[2:]])


def profile(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, ties by code."""
    kinds, counts = np.unique(codes, return_counts=True)
    if len(kinds) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        likely = counts >= least
        kinds, counts = kinds[likely], counts[likely]
    return kinds[np.lexsort((kinds, -counts))[:size]]


def profiles(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Staged ``lang, code, rank``: the first ``size`` n-grams of each language over
    all training texts (``lang`` not null, crc32 of the id mod 3 not 1)."""
    modulus, held = HELD_OUT
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held_codes = 0

        def merge() -> None:
            nonlocal held_codes
            for lang, parts in seen.items():
                kinds, counts = np.unique(np.concatenate(parts), return_counts=True)
                if lang in sums:
                    both, total = np.concatenate([sums[lang][0], kinds]), np.concatenate([sums[lang][1], counts])
                    kinds, at = np.unique(both, return_inverse=True)
                    counts = np.bincount(at, total).astype(np.int64)
                sums[lang] = kinds, counts
            seen.clear()
            held_codes = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (kinds, counts) in sums.items():
                for i in range(0, len(kinds), 50_000):
                    k, c = kinds[i : i + 50_000], counts[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c)], schema=schema)
            sums.clear()

        for batch in batches:
            for i, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text")):
                if lang is None or not (whole := text.as_py()) or crc_remainder(i, modulus) == held:
                    continue
                codes = ngrams(whole)
                seen.setdefault(lang, []).append(codes)
                held_codes += len(codes)
                if held_codes > MEMORY:
                    merge()
                    if sum(len(k) for k, _ in sums.values()) > MEMORY:
                        yield from flush()
        merge()
        yield from flush()

    counts = map_rows(docs.select(F.col("doc_id").cast("long"), "lang", "text"), count, "lang string, code bigint, n bigint")
    total = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return stage(top_per_group(total, ["lang"], [F.desc("n"), F.asc("code")], size).select("lang", "code", "rank"), "lang-profiles")


def _ranks(rows: pa.Table, langs: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes, and the rank of each (from 0) by language; ``size`` if absent."""
    codes = np.unique(rows["code"].to_numpy())
    table = np.full((len(langs), len(codes)), size, np.int32)
    number = {lang: k for k, lang in enumerate(langs)}
    of = np.array([number[x] for x in rows["lang"].to_pylist()], np.int64)
    table[of, np.searchsorted(codes, rows["code"].to_numpy())] = rows["rank"].to_numpy() - 1
    return codes, table


def distances(own: np.ndarray, codes: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """Out-of-place distance of a text's profile from every language's."""
    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    known = codes[at] == own
    places = np.arange(len(own))[known]
    ranks = table[:, at[known]]
    out = np.where(ranks == size, size, np.abs(ranks - places))
    return out.sum(axis=1) + size * (len(own) - len(places))


def predict(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs`` (``doc_id, lang,
    text``; other columns are ignored). The score is one less the distance's share
    of the largest possible distance.

    Null and empty texts and texts without a letter are ``und`` with score 0, as
    are all texts if nothing could be learnt. Of equal distances the first
    language by name counts. Repeated rows are learnt from and predicted each.
    Whole texts are read. An empty table gives an empty result."""
    learnt = profiles(docs, size)
    langs = sorted(r["lang"] for r in learnt.select("lang").distinct().collect())
    modulus, held = HELD_OUT
    kinds = "doc_id bigint, lang_pred string, distance bigint, longest bigint, text string"
    none = F.lit(None)
    rows = docs.select(
        F.col("doc_id").cast("long"), none.cast("string").alias("lang_pred"), none.cast("long").alias("distance"), none.cast("long").alias("longest"), "text")
    for start in range(0, len(langs), BLOCK):
        block = langs[start : start + BLOCK]
        codes, table = _ranks(learnt.where(F.col("lang").isin(block)).toArrow(), block, size)

        def compare(batches: Iterable[pa.RecordBatch], block=block, codes=codes, table=table, last=start + BLOCK >= len(langs)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, far, longest = (batch.column(n).to_pylist() for n in ("lang_pred", "distance", "longest"))
                for i, text in enumerate(batch.column("text")):
                    own = profile(ngrams(text.as_py() or ""), size)
                    if len(own):
                        d = distances(own, codes, table, size)
                        best = int(d.argmin())
                        if far[i] is None or d[best] < far[i]:
                            found[i], far[i], longest[i] = block[best], int(d[best]), size * len(own)
                text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text")  # wanted by a further block only
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(found, pa.string()), pa.array(far, pa.int64()), pa.array(longest, pa.int64()), text],
                    names=["doc_id", "lang_pred", "distance", "longest", "text"])

        rows = map_rows(rows, compare, kinds)

    score = F.when(F.col("longest") > 0, 1 - F.col("distance") / F.col("longest")).otherwise(0.0)
    return rows.select(
        "doc_id", (id_remainder(modulus) == held).alias("held_out"), F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))
