"""Raw dumps → classified, extracted items → daily documents (Q1, Q2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import extract as X
from newsloom.functions.dates import lunar_date
from newsloom.functions.text import norm_match, strip_hashtags, truncate
from newsloom.lexicon import categories as C
from newsloom.operators.places import alert_points, geocode
from newsloom.operators.scale import PART_SIZE, id_bucket, number_rows, pin, top_per_group
from newsloom.rules import Rule
from newsloom.session import stage_table
from newsloom.sinks.reports import day_documents, point_lists
from newsloom.sources import dumps as source

SUMMARY_LENGTH, DIGEST_LENGTH = 200, 300  # fixed values of the report format


def classify_messages(messages: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """H4: every message with ``category`` (also ``other`` and ``noise``), the
    ally ``flag`` and the normalised text ``normal`` used by later steps."""
    matched = pin(messages, normal=norm_match(F.col("text")))
    matched = pin(matched, lowered=F.lower("normal"))
    routed = pin(matched, route=X.classify_route(F.col("text"), F.col("lowered"), rules))
    return routed.select(
        *messages.columns, "normal", "lowered",
        X.route_category(F.col("route")).alias("category"), X.route_flag(F.col("route")).alias("flag"),
    )


def extract_items(classified: DataFrame) -> DataFrame:
    """One row per message with the fields of its category.

    Statement-only work is guarded by the category, so it runs on statements
    only; each expensive value is pinned and computed once.
    """
    category, text, normal = F.col("category"), F.col("text"), F.col("normal")
    statement = category == "bayanat"
    general = statement & X.is_general_statement(normal)
    operation = statement & ~X.is_general_statement(normal)
    step = pin(
        classified,
        general=F.coalesce(general, F.lit(False)),
        num=F.when(statement, X.statement_number(normal)),
        body=X.clean_body(F.when(operation, text)),
        summary=F.when(
            category.isin("enemy", "iran", "allies"), truncate(strip_hashtags(text), SUMMARY_LENGTH)
        ).when(category == "summaries", truncate(strip_hashtags(text), DIGEST_LENGTH)),
        media_key=F.when(category == "videos", X.media_key(text)),
        location=F.when(category == "sirens", X.alert_location(text)),
        source=F.when(category == "iran", X.pick_source(F.col("lowered"))),
        kind=F.when(category == "summaries", X.digest_kind(F.col("lowered"))),
    )
    is_general = F.col("general")
    step = pin(
        step,
        target=F.when(is_general, X.statement_title(normal)).when(statement, X.extract_target(F.col("body"))),
        weapon=F.when(is_general, F.lit("")).when(statement, X.extract_weapon(normal)),
        badge=F.when(is_general, F.lit("communique")).when(statement, X.classify_badge(text)),
        op_time=F.when(is_general, F.lit("")).when(statement, X.op_time(normal)),
        bayan_type=F.when(is_general, F.lit("statement")).when(statement, X.classify_type(normal, F.col("num"))),
    )
    return pin(
        step,
        tags=F.when(is_general, F.array(F.lit(C.GENERAL_TAG))).when(statement, X.extract_tags(text, F.col("badge"))),
        strikes=F.when(statement & ~is_general, X.parse_list_items(text, F.col("target"), normal)),
        description=truncate(F.col("media_key"), SUMMARY_LENGTH),
    ).drop("general", "body", "lowered", "normal")


def dedupe_media(items: DataFrame) -> DataFrame:
    """Of the videos of a day with equal time and cleaned description only
    the first is kept. Copies are cut to one per map task before the shuffle."""
    videos = items.where(F.col("category") == "videos")
    first = top_per_group(videos, ["date", "time", "media_key"], [F.col("id").asc()], 1, "__r").drop("__r")
    return items.where(F.col("category") != "videos").unionByName(first)


def number_items(items: DataFrame) -> DataFrame:
    """Position of each item inside its day and category, by message id."""
    return number_rows(items, ["date", "category"], ["id"], [id_bucket("id")], "position")


def day_headers(messages: DataFrame) -> DataFrame:
    """The first lunar date phrase among a day's messages."""
    found = pin(messages.select("id", "date", "text"), phrase=lunar_date(F.col("text")))
    return found.groupBy("date").agg(
        F.coalesce(F.min_by("phrase", F.when(F.col("phrase").isNotNull(), F.col("id"))), F.lit("")).alias("hijri")
    )


def ingest(
    spark: SparkSession, path: str | list[str], existing: DataFrame | None = None,
    rules: Sequence[Rule] | None = None, stage: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Q1, Q2: ``(items, headers)`` of all days in the dumps that are not yet in
    ``existing``. The whole archive is one job; parsing and classification are
    staged once, because several outputs read them."""
    records = source.read_day_records(spark, path)
    if existing is not None:
        records = source.skip_existing_days(records, existing)
    bare = records.select(F.regexp_replace("record", r"^ID:\s*", "").alias("record"))
    classified = classify_messages(source.parse_record_header(bare), rules)
    items = extract_items(classified)
    if stage:
        items = stage_table(items, "items", partition_by="category")
    kept = dedupe_media(items.where(~F.col("category").isin(X.NOISE, X.OTHER)))
    return number_items(kept), day_headers(items)


def ingest_documents(
    spark: SparkSession, path: str | list[str], gazetteer: DataFrame | None = None, existing: DataFrame | None = None,
    rules: Sequence[Rule] | None = None, part_size: int = PART_SIZE,
) -> DataFrame:
    """Q1, Q2 to the end: the day documents of all new days, with alert points
    where a gazetteer is given (the longest place name in an alert counts)."""
    items, headers = ingest(spark, path, existing, rules)
    points = None
    if gazetteer is not None:
        gazetteer = stage_table(gazetteer.select("name", "lat", "lng", "priority"), "gazetteer")  # read by several jobs
        alerts = items.where(F.col("category") == "sirens").select("date", "position", "id", "time", "location")
        points = point_lists(alert_points(geocode(alerts, "location", gazetteer, "longest"), part_size=part_size))
    return day_documents(items, headers, points, part_size)
