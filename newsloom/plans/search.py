"""Text search over the event table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import extract_date_range
from newsloom.functions.text import has_latin
from newsloom.functions.translit import keyboard_transliterate, phonetic_transliterate, resolve_aliases
from newsloom.operators.counts import kpi_counts
from newsloom.operators.events import FETCH_LIMIT, SHOWN_LIMIT, date_filter
from newsloom.operators.index import (
    FIELDS, all_words_filter, like_all_words, match_terms_indexed, search_terms, substring_flag, term_flag, token_text,
)
from newsloom.operators.scale import pin, top_per_group
from newsloom.operators.sets import union_dedupe
from newsloom.schemas import CATEGORIES


def interpret(spark: SparkSession, query: str, as_of: dt.date, aliases: dict[str, str] | None = None) -> dict:
    """Date range and word variants of one search text (one tiny row)."""
    row = spark.range(1).select(F.lit(query).alias("q"), extract_date_range(F.lit(query), F.lit(as_of)).alias("d"))
    row = row.select("d", F.when(F.col("d.type").isNotNull(), F.col("d.remaining")).otherwise(F.col("q")).alias("t"))
    row = row.select(
        "d", F.trim("t").alias("text"), resolve_aliases(F.col("t"), aliases or {}).alias("resolved"),
        has_latin(F.col("t")).alias("latin"),
        keyboard_transliterate(F.col("t")).alias("keyboard"), phonetic_transliterate(F.col("t")).alias("phonetic"),
    ).first()
    variants = [row["resolved"].split()]
    if row["latin"]:
        variants += [row["keyboard"].split(), row["phonetic"].split()]
    return {"date": row["d"], "text": row["text"], "variants": variants if row["text"] else []}


def _in_range(events: DataFrame, date) -> DataFrame:
    return events if date["type"] is None else events.where(date_filter(date["type"], date["start"], date["end"]))


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def _newest() -> list[Column]:
    return [F.desc("date"), F.desc_nulls_last("time"), F.asc("id")]


def match_variants(events: DataFrame, variants: Sequence[Sequence[str]], limit: int | None = None) -> DataFrame:
    """All candidate queries of a search in one scan, rows in no order.

    Each variant is searched by prefix terms, or by substrings if one of its words
    is a single character or no row has its terms. Both kinds of all variants are
    flags of one scan, whose texts are normalised once. One aggregate over the
    same rows says for every variant whether its terms are found; it is a scalar of
    the plan, so the table is read twice at most. ``limit``: the newest rows of each
    variant, cut in every task before they meet."""
    plans = [(list(words), search_terms(words)) for words in variants if words]
    plans = [(words, [] if any(len(w) < 2 for w in words) else terms, any(len(w) < 2 for w in words)) for words, terms in plans]
    plans = [p for p in plans if p[1] or p[2]]
    if not plans:
        return events.limit(0)
    fields = [F.col(f) for f in FIELDS]
    by_term = [term_flag(F.col("__tokens"), terms) if terms else F.lit(False) for _, terms, _ in plans]
    by_part = [substring_flag(F.col("__lower"), words) for words, _, _ in plans]
    texts = pin(
        events, __tokens=F.array(*[token_text(f) for f in fields] if any(terms for _, terms, _ in plans) else [F.lit("")]),
        __lower=F.array(*[F.lower(F.coalesce(f, F.lit(""))) for f in fields]))
    flagged = pin(texts, __t=F.array(*by_term), __s=F.array(*by_part)).drop("__tokens", "__lower")
    hits = flagged.where(F.exists("__t", lambda x: x) | F.exists("__s", lambda x: x))
    if any(terms for _, terms, _ in plans):
        some = hits.agg(F.array(*[F.coalesce(F.bool_or(F.col("__t")[i]), F.lit(False)) for i in range(len(plans))]).alias("some")).scalar()
        hits = hits.withColumn("__some", some)
    chosen = [F.col("__s")[i] if short else F.when(F.col("__some")[i], F.col("__t")[i]).otherwise(F.col("__s")[i]) for i, (_, _, short) in enumerate(plans)]
    if limit is None:
        return hits.where(reduce(lambda a, b: a | b, chosen)).select(*events.columns)
    matched = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(chosen)]))
    one_each = hits.select(*events.columns, F.explode(matched).alias("__variant"))
    return top_per_group(one_each, ["__variant"], _newest(), limit, "__rank").select(*events.columns)


def query_events(events: DataFrame, words: Sequence[str], postings: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One candidate query: prefix terms first; substring matching if a word is
    a single character or the terms find nothing. All hits are returned; a page
    passes its fetch size (``FETCH_LIMIT``) as the limit of each candidate query.

    With ``postings`` the terms are looked up in the index; the second search is
    added under an uncorrelated existence test of the first, so it runs only if
    needed and no result is fetched to decide."""
    if postings is None or any(len(w) < 2 for w in words):
        return _first(match_variants(events, [words]).orderBy(*_newest()), limit)
    terms = search_terms(words)
    if not terms:
        return events.limit(0)
    hits = match_terms_indexed(events, postings, terms)
    fallback = like_all_words(events.where(~hits.select("id").limit(1).exists()), words)
    return _first(hits.unionByName(fallback).orderBy(*_newest()), limit)


def search(
    events: DataFrame, query: str, as_of: dt.date, aliases: dict[str, str] | None = None,
    postings: DataFrame | None = None, limit: int | None = None,
) -> DataFrame:
    """Q5: all result rows in display order; ``limit`` as in ``query_events``.

    A query that is only a date gives that range in ascending order; otherwise
    the word variants are searched, merged without duplicates (G1) and sorted
    newest first (F2)."""
    plan = interpret(events.sparkSession, query, as_of, aliases)
    rows = _in_range(events, plan["date"])
    if not query.strip():
        return events.limit(0)
    if not plan["variants"]:
        return _first(rows.orderBy("date", "time", "id"), limit)
    if postings is None:
        parts = [match_variants(rows, plan["variants"], limit)]
    else:
        parts = [query_events(rows, words, postings, limit) for words in plan["variants"] if words]
    return union_dedupe(parts, ["id"]).orderBy(*_newest())


def result_page(results: DataFrame, shown: int = SHOWN_LIMIT) -> tuple[DataFrame, DataFrame]:
    """the rows shown and the number of further results."""
    more = results.agg(F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("more"))
    return results.limit(shown), more


def in_page_search(events: DataFrame, text: str, query: str, aliases: dict[str, str] | None = None,
                   categories: Sequence[str] = CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """Rows whose text has all words, and their counts per category.
    An alias is tried for the whole query, then for each word."""
    table = {k.lower(): v for k, v in (aliases or {}).items()}
    words = (table.get(query.lower()) or query).split()
    found = events.where(all_words_filter(F.col(text), [table.get(w.lower(), w.lower()) for w in words]))
    return found, kpi_counts(found, categories)
