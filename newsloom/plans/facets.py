"""Facet vocabularies, per-item facets and day keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import classify as K
from newsloom.functions.arrays import omit_empty_array
from newsloom.lexicon import statistics as V
from newsloom.operators.places import coords_by_day
from newsloom.operators.scale import collect_parts, top_per_group
from newsloom.rules import listed_terms

CAPPED = {"targets": V.FACET_CAP, "locations": V.FACET_CAP}


def facet_items(events: DataFrame) -> DataFrame:
    """Cleaned facet values of each event at its position; a value that
    says nothing is null."""
    statement, alert, ally = (F.col("category") == c for c in ("bayanat", "sirens", "allies"))
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), K.clean_tag), lambda t: t.isNotNull())
    return events.where(statement | alert | ally).select(
        "id", "date", "category", "src_idx",
        F.when(statement, K.canonical_weapon(F.col("subtitle"))).alias("weapon"),
        F.when(statement, K.clean_target(F.col("title"), F.col("badge"))).alias("target"),
        F.when(statement, F.nullif(F.trim("badge"), F.lit(""))).alias("badge"),
        F.when(statement, omit_empty_array(tags)).alias("tags"),
        F.when(statement, F.col("num")).alias("num"),
        F.when(alert, K.clean_location_value(F.col("location"))).alias("location"),
        F.when(ally, F.nullif(F.trim("subtitle"), F.lit(""))).alias("flag"),
    )


def facet_counts(items: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Values per facet with counts; ties by first appearance. The page's
    report (``caps=CAPPED``) has the most frequent values only of two facets.

    All facets are counted in one pass over the items; the counts per value are
    combined in each map task."""
    pairs = F.concat(
        F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in
                  (("weapons", "weapon"), ("targets", "target"), ("badges", "badge"), ("locations", "location"), ("flags", "flag"))]),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("tags").alias("facet"), t.alias("value"))),
    )
    counted = (
        items.select("id", F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))
        .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    )
    labelled = counted.withColumn(
        "label", F.when(F.col("facet") == "badges", K.badge_label(F.col("value"))).otherwise(F.col("value"))
    )
    if not caps:
        return labelled
    # An uncapped value is ranked alone, so one rank filter serves all facets and
    # every task keeps at most the cap before the shuffle.
    cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col("facet")), F.lit(1))
    alone = F.when(~F.col("facet").isin(*caps), F.col("value"))
    ranked = top_per_group(
        labelled.withColumn("__alone", alone).withColumn("__cap", cap), ["facet", "__alone"],
        [F.desc("n"), F.asc("first_id")], max(caps.values()), "__rank",
    )
    return ranked.where(F.col("__rank") <= F.col("__cap")).drop("__alone", "__cap", "__rank")


def facets(events: DataFrame, points: DataFrame, caps: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Q7: the three facet datasets."""
    items = facet_items(events)
    return {"facet_counts": facet_counts(items, caps), "facet_items": items, "coords": coords_by_day(points, "last")}


def keyword_rows(events: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """D24 in long form: distinct ``date, keyword``."""
    none = F.array().cast("array<string>")
    category = F.col("category")

    def one(column: str) -> Column:
        return F.array(F.col(column))

    words = F.filter(F.split(F.regexp_replace("location", r"(?U)\s+", " "), " "), lambda w: F.length(w) >= 3)
    found = (
        F.when(category == "bayanat", F.concat(one("title"), one("subtitle"), F.coalesce("tags", none),
                                               F.coalesce(listed_terms(F.col("full_text"), V.STATEMENT_TERMS), none)))
        .when(category == "sirens", F.coalesce(words, none))
        .when(category == "enemy", listed_terms(F.col("title"), V.MEDIA_TERMS))
        .when(category == "iran", F.concat(one("subtitle"), F.coalesce(listed_terms(F.col("title"), V.STATE_TERMS), none)))
        .when(category == "allies", one("subtitle"))
        .otherwise(none)
    )
    rows = events.select("date", F.explode(F.array_distinct(found)).alias("keyword"))
    if points is not None:
        rows = rows.unionByName(points.select("date", F.col("loc").alias("keyword")))
    return rows.where(F.col("keyword") != "").distinct()


def day_keywords(keywords: DataFrame, part_size: int = 100_000) -> DataFrame:
    """The sorted keywords of a day as one text (in parts if a day has
    more than ``part_size``). Sorting is split by the first twelve characters, since
    place names often begin alike."""
    parts = collect_parts(
        keywords, ["date"], ["keyword"], [F.substring("keyword", 1, 12)], F.col("keyword"), "list", part_size
    )
    return parts.select("date", "part", F.array_join("list", " ").alias("keywords"))


def day_index(report_rows: DataFrame, keywords: DataFrame) -> DataFrame:
    """Newest day first, with counters and keywords."""
    return report_rows.join(day_keywords(keywords), "date", "left").orderBy(F.desc("date"), "part")
