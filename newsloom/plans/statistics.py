"""Operation statistics of a date range."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.geo import round_exact
from newsloom.functions.classify import classify_target_type, classify_weapon_family, counter_attack_kind
from newsloom.lexicon import statistics as V
from newsloom.operators.scale import pin
from newsloom.rules import count_mentions, java_regex


def operation_rows(
    statements: DataFrame, border_towns: Sequence[str] = (), known_settlements: Sequence[str] = ()
) -> DataFrame:
    """D12 as rows: one per counted operation with its buckets.

    Input: ``date, bayan_type, target, weapon, badge, strikes, full_text``. A
    ``list_strikes`` statement gives one row per nested item, every other one a
    single row. ``statement`` rows carry no operation and are left out.
    """
    is_list = (F.col("bayan_type") == "list_strikes") & (F.size(F.coalesce("strikes", F.array())) > 0)
    own = F.array(F.struct(F.col("target").alias("target"), F.col("weapon").alias("weapon")))
    nested = F.transform(
        "strikes",
        lambda s: F.struct(s["target"].alias("target"), F.coalesce(F.nullif(s["weapon"], F.lit("")), F.col("weapon")).alias("weapon")),
    )
    rows = statements.where(~F.col("bayan_type").eqNullSafe("statement")).select(
        "date", "bayan_type", "badge",
        F.when(F.col("bayan_type") == "defensive", counter_attack_kind(F.col("full_text"))).alias("counter_kind"),
        F.explode(F.when(is_list, nested).otherwise(own)).alias("op"),
    )
    bucketed = pin(
        rows,
        weapon_family=classify_weapon_family(F.col("op.weapon")),
        place_type=classify_target_type(F.col("op.target"), F.col("badge"), border_towns, known_settlements),
    )
    target_type = F.when(F.col("weapon_family") == V.AIR_DEFENCE, V.AIRCRAFT_TYPE).otherwise(F.col("place_type"))
    typed = bucketed.select("date", "bayan_type", "counter_kind", "weapon_family", target_type.alias("target_type"))
    defensive = F.coalesce(F.col("bayan_type") == "defensive", F.lit(False))
    advance = F.col("target_type") == V.COUNTER_ADVANCE_TYPE
    return typed.select(
        "*",
        defensive.alias("is_defensive"),
        (~defensive & ~advance).alias("is_offensive"),
        F.when(defensive, F.coalesce(F.col("counter_kind") == "advance", F.lit(False))).otherwise(advance).alias("is_advance"),
        F.coalesce(F.col("counter_kind") == "landing", F.lit(False)).alias("is_landing"),
    )


def single_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Put one-row results side by side: their union is folded into one row, so
    no join is involved."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def _flag(name: str) -> Column:
    return F.count(F.when(F.col(name), 1))


def operation_totals(operations: DataFrame) -> DataFrame:
    """Totals. ``operations`` is the published sum, in which a defensive
    row that mentions an advance counts twice; ``operations_distinct`` is the
    number of rows."""
    row = operations.agg(
        _flag("is_offensive").alias("offensive_strikes"), _flag("is_defensive").alias("defensive_ops"),
        _flag("is_advance").alias("counter_advance"), _flag("is_landing").alias("counter_landing"),
        F.count(F.lit(1)).alias("operations_distinct"),
    )
    total = F.col("offensive_strikes") + F.col("defensive_ops") + F.col("counter_advance")
    return row.select(total.alias("operations"), "*")


def bucket_counts(operations: DataFrame) -> DataFrame:
    """Counts per target type and per weapon family in long form."""
    pairs = F.array(
        F.struct(F.lit("target").alias("dimension"), F.col("target_type").alias("bucket")),
        F.struct(F.lit("weapon").alias("dimension"), F.col("weapon_family").alias("bucket")),
    )
    return operations.select(F.inline(pairs)).groupBy("dimension", "bucket").agg(F.count(F.lit(1)).alias("n"))


def mention_counts(texts: DataFrame, rules: Sequence[tuple[str, str]] = V.LOSS_RULES, column: str = "full_text") -> DataFrame:
    """Total matches of each rule over all texts, one scan, long form."""
    row = texts.agg(*[F.sum(count_mentions(F.col(column), p)).cast("long").alias(f"r{i}") for i, (_, p) in enumerate(rules)])
    pairs = F.array(
        *[F.struct(F.lit(k).alias("label"), F.coalesce(F.col(f"r{i}"), F.lit(0)).alias("n")) for i, (k, _) in enumerate(rules)]
    )
    return row.select(F.inline(pairs))


def captured_sum(text: Column, pattern: str) -> Column:
    """Sum of the integers captured by group 1 in one text."""
    numbers = F.regexp_extract_all(text, F.lit(java_regex(pattern)), F.lit(1))
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, n: acc + F.coalesce(n.try_cast("long"), F.lit(0)))


def number_sum(texts: DataFrame, pattern: str = V.CASUALTY_NUMBER, column: str = "full_text") -> DataFrame:
    """D15 over all texts."""
    return texts.agg(F.coalesce(F.sum(captured_sum(F.col(column), pattern)), F.lit(0)).alias("total"))


def activity_summary(days: DataFrame, operations: DataFrame, total: Column | None = None) -> DataFrame:
    """Days scanned, active days, daily average (1 decimal, half-even) and
    the largest day (ties: the earliest). ``days`` has one row per day scanned."""
    per_day = operations.groupBy("date").agg(F.count(F.lit(1)).alias("n"), *_published_parts())
    early = -F.datediff("date", F.lit("1970-01-01").cast("date"))
    summed = F.sum(F.col("published")) if total is None else total
    active = per_day.agg(
        F.count(F.lit(1)).alias("active_days"), F.coalesce(summed, F.lit(0)).alias("operations"),
        F.max_by("date", F.struct("n", early)).alias("max_date"), F.max("n").alias("max_count"),
    )
    scanned = days.agg(F.countDistinct("date").alias("days_scanned"))
    row = single_row([scanned, active])
    average = F.when(F.col("active_days") > 0, round_exact(F.col("operations") / F.col("active_days"), 1)).otherwise(F.lit(0.0))
    return row.select(
        "days_scanned", "active_days", average.alias("daily_avg"), "max_date", F.coalesce("max_count", F.lit(0)).alias("max_count")
    )


def _published_parts() -> list[Column]:
    return [(_flag("is_offensive") + _flag("is_defensive") + _flag("is_advance")).alias("published")]


def range_statistics(
    statements: DataFrame, days: DataFrame, border_towns: Sequence[str] = (), known_settlements: Sequence[str] = ()
) -> DataFrame:
    """The whole statistics document as one nested row. Each part is a
    small aggregate; they are joined as single rows."""
    operations = operation_rows(statements, border_towns, known_settlements)
    fighting = statements.where(~F.col("bayan_type").eqNullSafe("statement"))
    excluded = statements.agg(F.count(F.when(F.col("bayan_type") == "statement", 1)).alias("statements_excluded"))

    def ranked(rows: DataFrame, label: str, name: str) -> DataFrame:
        entry = F.struct((-F.col("n")).alias("o"), F.col(label).alias("k"), F.col("n").alias("v"))
        listed = rows.where(F.col("n") > 0).agg(F.array_sort(F.collect_list(entry)).alias("l"))
        return listed.select(F.map_from_entries(F.transform("l", lambda x: F.struct(x["k"], x["v"]))).alias(name))

    buckets = bucket_counts(operations)
    casualties = number_sum(fighting).select(F.lit(V.CASUALTY_KEY).alias("label"), F.col("total").alias("n"))
    losses = mention_counts(fighting).unionByName(casualties)
    extent = days.agg(F.min("date").alias("from"), F.max("date").alias("to"))
    parts = [
        operation_totals(operations), activity_summary(days, operations), excluded, extent,
        ranked(buckets.where(F.col("dimension") == "target"), "bucket", "targets"),
        ranked(buckets.where(F.col("dimension") == "weapon"), "bucket", "weapons"),
        ranked(losses, "label", "losses"),
    ]
    return single_row(parts).select(
        F.struct("from", "to", "days_scanned", F.coalesce("active_days", F.lit(0)).alias("active_days")).alias("period"),
        F.struct(
            "operations", "operations_distinct", "offensive_strikes", "defensive_ops", "counter_advance", "counter_landing",
            "statements_excluded", "daily_avg", F.struct(F.col("max_date").alias("date"), F.col("max_count").alias("count")).alias("max_single_day"),
        ).alias("totals"),
        "targets", "weapons", "losses",
    )


def statistics_json(document: DataFrame) -> DataFrame:
    """The statistics document as one JSON text."""
    return document.select(F.to_json(F.struct(*document.columns)).alias("json"))
