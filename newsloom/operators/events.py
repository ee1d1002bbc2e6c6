"""Filters, projections and paging over the event table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import norm_index, null_to_empty, truncate
from newsloom.lexicon import statistics as V
from newsloom.rules import contains_any
from newsloom.schemas import CATEGORIES

SORT_KEYS = ("date", *CATEGORIES[:5], "total")
DEFAULT_SORT = "total"
FETCH_LIMIT, SHOWN_LIMIT = 80, 40  # fixed values of the search page


def filter_events(
    events: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
    categories: Sequence[str] | None = None, all_categories: Sequence[str] = CATEGORIES,
) -> DataFrame:
    """Inclusive dates and a category list. No category, or all of them,
    means no category filter."""
    if start is not None:
        events = events.where(F.col("date") >= F.lit(start))
    if end is not None:
        events = events.where(F.col("date") <= F.lit(end))
    if categories and len(categories) < len(all_categories):
        events = events.where(F.col("category").isin(*categories))
    return events


def valid_time(time: Column) -> Column:
    """B4."""
    return F.length(time) >= 5


def date_filter(kind: str, start: dt.date, end: dt.date) -> Column:
    """B8."""
    return F.col("date") == F.lit(start) if kind == "single" else F.col("date").between(F.lit(start), F.lit(end))


def category_filter(category: str) -> Column:
    """``all`` keeps everything."""
    return F.lit(True) if category == "all" else F.col("category") == category


def attribute_filter(name: str, badge: Column, title: Column, tags: Column) -> Column:
    """B10 for statements: settlement, tank, deep, hit, air or all."""
    words = {
        "settlement": badge == "settlement",
        "tank": (badge == "tank") | title.contains(V.TANK_WORD),
        "deep": (badge == "deep") | contains_any(title, V.BASE_WORDS),
        "hit": F.exists(tags, lambda t: t.contains(V.HIT_WORD)),
        "air": contains_any(title, V.AIRCRAFT_WORDS),
    }
    return F.lit(True) if name == "all" else F.coalesce(words[name], F.lit(False))


def keyword_filter(name: str, text: Column, special: dict[str, Sequence[str]] | None = None) -> Column:
    """B10 for the other pages: ``all``, a named keyword group, ``r:word`` or a word."""
    if name == "all":
        return F.lit(True)
    if special and name in special:
        return contains_any(text, special[name])
    return text.contains(name[2:] if name.startswith("r:") else name)


def sort_key(name: str, allowed: Sequence[str] = SORT_KEYS, default: str = DEFAULT_SORT) -> str:
    """An unknown sort column becomes the default."""
    return name if name in allowed else default


def page(
    rows: DataFrame, key: str, descending: bool = True, number: int = 1, size: int = 10,
    allowed: Sequence[str] = SORT_KEYS,
) -> DataFrame:
    """one page of a day table; ties are ordered by date, newest first.

    The input is a day table (one row per calendar day), so ordering it is cheap
    whatever the size of the archive."""
    key = sort_key(key, allowed)
    order = [F.col(key).desc() if descending else F.col(key).asc()]
    if key != "date":
        order.append(F.col("date").desc())
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(events: DataFrame, size: int = 10) -> DataFrame:
    """Distinct days and the pages they fill (at least one)."""
    days = F.countDistinct("date")
    return events.agg(days.alias("days"), F.greatest(F.lit(1), F.ceil(days / size)).cast("long").alias("pages"))


def search_entry(events: DataFrame) -> DataFrame:
    """Narrow search rows; the full text stays out."""
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    title, subtitle = null_to_empty(F.col("title")), null_to_empty(F.col("subtitle"))
    parts = (
        F.when(F.col("category") == "bayanat", F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (title, subtitle, tags)]))
        .when(F.col("category").isin("iran", "allies"), F.concat_ws(" ", F.nullif(subtitle, F.lit("")), F.nullif(title, F.lit(""))))
        .otherwise(title)
    )
    shown = (
        F.when(F.col("category") == "bayanat", F.concat(F.lit("بيان #"), F.coalesce(F.col("num").cast("string"), F.lit(""))))
        .when(F.col("category").isin("iran", "allies"), subtitle)
        .otherwise("")
    )
    plain = F.col("category").isin("bayanat", "sirens")
    return events.select(
        "id",
        F.coalesce(F.nullif("op_time", F.lit("")), F.col("time"), F.lit("")).alias("time"),
        F.when(plain, title).otherwise(truncate(title, 80)).alias("title"),
        shown.alias("subtitle"), norm_index(parts).alias("norm_text"),
        F.col("src_idx").alias("src_idx"), "category", "date",
    )


def raw_export(events: DataFrame) -> DataFrame:
    """all rows by date, then time (range-partitioned sort, no single task)."""
    return events.select("date", "time", "category", "title", "subtitle", "location", "full_text", "id").orderBy(
        "date", "time", "id"
    ).drop("id")
