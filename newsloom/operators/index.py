"""Inverted index over the event text."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import let, norm_index

FIELDS = ("title", "full_text", "location", "subtitle")  # fixed: the indexed columns
RESERVED = re.compile(r"\b(AND|OR|NOT|NEAR)\b", re.IGNORECASE)
OPERATORS = re.compile(r'["*()+^:]')
NOT_TOKEN = r"[^\p{L}\p{N}]+"
BLOCK_BYTES = 4_000_000


def token_text(text: Column) -> Column:
    """Normalised tokens joined by single blanks, with a blank in front. A
    phrase prefix is then one substring test."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(norm_index(F.coalesce(text, F.lit(""))), NOT_TOKEN, " ")))


def tokens(text: Column) -> Column:
    return F.filter(F.split(token_text(text), " "), lambda t: t != "")


def search_terms(words: Sequence[str]) -> list[str]:
    """Words without operators and reserved words; empty ones dropped."""
    cleaned = [RESERVED.sub("", OPERATORS.sub("", w)) for w in words]
    return [w for w in cleaned if w]


def _term_key(term: str) -> Column:
    return token_text(F.lit(term))


def match_terms(rows: DataFrame, terms: Sequence[str], fields: Sequence[str] = FIELDS) -> DataFrame:
    """C1 by scan: every term is a token prefix (a phrase, if it has several
    tokens) in some field. A plain filter: no shuffle, and column and partition
    pruning stay in force."""

    return rows.where(_all_in_some([token_text(F.col(f)) for f in fields], [_term_key(t) for t in terms]))


def _all_in_some(texts: Sequence[Column], needles: Sequence[Column]) -> Column:
    """Every needle is a substring of some text. The prepared texts are bound
    once per row, whatever the number of needles."""

    def some(bound: Column, needle: Column) -> Column:
        return F.exists(bound, lambda text: text.contains(needle))

    return let(F.array(*texts), lambda bound: reduce(lambda a, b: a & b, [some(bound, n) for n in needles]))


def build_postings(rows: DataFrame, fields: Sequence[str] = FIELDS, key: str = "id") -> DataFrame:
    """M7: ``token, id, date`` with duplicates removed inside each row, so the
    build needs no shuffle of its own."""
    every = F.array_distinct(F.concat(*[tokens(F.col(f)) for f in fields]))
    extra = ["date"] if "date" in rows.columns else []
    return rows.select(F.explode(every).alias("token"), key, *extra)


def write_postings(postings: DataFrame, path: str, files: int, key: str = "id", segment: str = "base") -> None:
    """Store a segment of the index sorted by (token, id). Range partitioning on
    both keeps a very common token from filling one file; the token statistics of
    the files and of their blocks (``BLOCK_BYTES``) let a lookup skip all others.

    New rows are added as a further segment, without a rebuild. A segment that is
    written again replaces itself only, so a job that failed can be run again."""
    (
        postings.repartitionByRange(files, "token", key).sortWithinPartitions("token", key)
        .write.mode("overwrite").option("parquet.block.size", BLOCK_BYTES).parquet(f"{path}/segment={segment}")
    )


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """All segments of a stored index. A row that changed may have postings in
    several; candidates are confirmed on the rows, so old ones do no harm."""
    return spark.read.parquet(path).drop("segment")


def merge_postings(spark: SparkSession, path: str, target: str, files: int, key: str = "id") -> None:
    """All segments as one, in another folder: readers go on with the old one."""
    write_postings(read_postings(spark, path).distinct(), target, files, key)


def lookup(postings: DataFrame, terms: Sequence[str], key: str = "id") -> DataFrame:
    """C1 by index: ids that have a token for every term prefix. Each token of a
    multi-token term must be present; the order of a phrase is checked on the
    candidates by ``match_terms``.

    The range condition on the token reaches the files as a pushed filter; of the
    remaining postings the distinct pieces found are counted per id."""
    wanted: list[tuple[str, bool]] = []
    for term in terms:
        pieces = _python_tokens(term)
        wanted += [(p, False) for p in pieces[:-1]] + [(pieces[-1], True)] if pieces else []
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return postings.select(key).limit(0)

    def hit(piece: str, prefix: bool) -> Column:
        return F.col("token").startswith(piece) if prefix else F.col("token") == piece

    tests = [hit(p, prefix) for p, prefix in wanted]
    candidates = postings.where(reduce(lambda a, b: a | b, tests))
    if len(tests) == 1:
        return candidates.select(key).distinct()
    found = F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))
    return (
        candidates.select(key, F.explode(found).alias("piece")).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == len(tests)).select(key)
    )


def _python_tokens(term: str) -> list[str]:
    from newsloom.functions.text import MARKS_WIDE, SUPERSCRIPT_ALEF, _INDEX_MAP

    table = {ord(k): v for k, v in _INDEX_MAP.items()} | {ord(c): None for c in MARKS_WIDE + SUPERSCRIPT_ALEF}
    return re.findall(r"[^\W_]+", term.translate(table).lower())


def match_terms_indexed(rows: DataFrame, postings: DataFrame, terms: Sequence[str], fields: Sequence[str] = FIELDS,
                        key: str = "id") -> DataFrame:
    """Candidates from the index, confirmed on the rows."""
    return match_terms(rows.join(lookup(postings, terms, key), key, "left_semi"), terms, fields)


def _in_some(texts: Column, needle: Column) -> Column:
    return F.exists(texts, lambda text: text.contains(needle))


def term_flag(texts: Column, terms: Sequence[str]) -> Column:
    """C1 on prepared texts (``token_text`` of the fields)."""
    return reduce(lambda a, b: a & b, [_in_some(texts, _term_key(t)) for t in terms])


def substring_flag(texts: Column, words: Sequence[str]) -> Column:
    """B7 on prepared texts (the lower-cased fields)."""
    return reduce(lambda a, b: a & b, [_in_some(texts, F.lit(w.lower())) for w in words])


def like_all_words(rows: DataFrame, words: Sequence[str], fields: Sequence[str] = FIELDS) -> DataFrame:
    """Every word is a substring of some field, ASCII case ignored."""

    texts = [F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields]
    return rows.where(_all_in_some(texts, [F.lit(w.lower()) for w in words]))


def all_words_filter(text: Column, words: Sequence[str]) -> Column:
    """Every normalised word is a substring of the normalised text."""
    return _all_in_some([norm_index(F.coalesce(text, F.lit("")))], [norm_index(F.lit(w)) for w in words])
