"""The four category pages: types, labels, places and hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.classify import keyword_label, keyword_labels
from newsloom.functions.text import null_to_empty
from newsloom.lexicon import statistics as V
from newsloom.operators import counts as K
from newsloom.rules import contains_any

TOP_PLACES, TOP_REGIONS, TOP_OUTLETS = 7, 9, 8  # fixed list lengths of the pages


def has_hit(tags: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda t: t.contains(V.HIT_WORD)), F.lit(False))


def alert_kind(location: Column) -> Column:
    """Drone alerts by keyword, the rest are rockets."""
    return F.when(contains_any(null_to_empty(location), V.DRONE_ALERT_WORDS), "drone").otherwise("rocket")


def statement_page(events: DataFrame, places: Sequence[str]) -> dict[str, DataFrame]:
    """Operation classes, weapons, hits, the most named places, hours."""
    rows = events.where(F.col("category") == "bayanat")
    title = null_to_empty(F.col("title"))
    kind = K.operation_class(null_to_empty(F.col("badge")), title, V.TANK_WORD, V.BASE_WORDS, V.AIRCRAFT_WORDS)
    named = keyword_label(title, [(p, (p,)) for p in places]) if places else F.lit(None).cast("string")
    return {
        "classes": K.type_dashboard(rows, kind),
        "weapons": K.type_dashboard(rows, F.coalesce(F.nullif("subtitle", F.lit("")), F.lit(V.OTHER))),
        "hits": rows.agg(K.count_if(has_hit(F.col("tags"))).alias("hits"), F.count(F.lit(1)).alias("rows")),
        "places": K.type_dashboard(rows, named, TOP_PLACES),
        "hours": K.hour_density(rows.withColumn("time", F.coalesce(F.nullif("op_time", F.lit("")), "time")), dense=True),
    }


def alert_page(events: DataFrame) -> dict[str, DataFrame]:
    """Regions, the two kinds, hours."""
    rows = events.where(F.col("category") == "sirens")
    return {
        "regions": K.type_dashboard(rows, keyword_label(F.col("location"), V.ALERT_REGIONS), TOP_REGIONS),
        "kinds": K.type_dashboard(rows, alert_kind(F.col("location"))),
        "hours": K.hour_density(rows, dense=True),
    }


def media_page(events: DataFrame) -> dict[str, DataFrame]:
    """Outlets, topics, hours."""
    rows = events.where(F.col("category") == "enemy")
    return {
        "outlets": K.type_dashboard(rows, keyword_label(F.col("title"), V.MEDIA_OUTLETS), TOP_OUTLETS),
        "topics": K.type_dashboard(rows, keyword_label(null_to_empty(F.col("title")), V.MEDIA_TOPICS, F.lit("other"))),
        "hours": K.hour_density(rows, dense=True),
    }


def state_page(events: DataFrame) -> dict[str, DataFrame]:
    """Two exclusive and four independent labels, hours."""
    rows = events.where(F.col("category") == "iran")
    text = F.concat_ws(" ", F.col("subtitle"), F.col("title"))
    exclusive = F.array_compact(F.array(keyword_label(text, V.STATE_EXCLUSIVE)))
    return {
        "labels": K.multi_label_counts(rows, F.concat(exclusive, keyword_labels(text, V.STATE_LABELS))),
        "hours": K.hour_density(rows, dense=True),
    }


def day_headlines(events: DataFrame) -> DataFrame:
    """Headline numbers of every day."""
    title, badge = null_to_empty(F.col("title")), null_to_empty(F.col("badge"))
    return K.headline_counts(
        events, (badge == "tank") | title.contains(V.TANK_WORD), has_hit(F.col("tags")), contains_any(title, V.AIRCRAFT_WORDS),
        badge == "settlement", (badge == "deep") | title.contains(V.BASE_WORDS[0]),
        F.col("category") == "bayanat", F.col("category") == "sirens",
    )
