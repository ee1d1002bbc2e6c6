"""Month summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import month_ordinal, pick
from newsloom.lexicon.statistics import MONTH_FALL, MONTH_RISE, POINT_FALLBACK, POINT_LABELS, TREND_LIMIT
from newsloom.operators import counts as K
from newsloom.operators.sequence import month_trend, prev_next, top_days_in_order
from newsloom.operators.scale import top_per_group
from newsloom.schemas import CATEGORIES


def month_calendar(months: DataFrame) -> DataFrame:
    """C14: twelve months of every year present, with counts where there are
    data. Bounded by the calendar."""
    years = months.select(F.year("month").alias("year")).distinct()
    grid = years.select(F.explode(F.sequence(
        F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(1)), F.expr("interval 1 month")
    )).alias("month"))
    return grid.join(months, "month", "left").withColumn("has_data", F.col("days").isNotNull())


def day_targets(events: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` distinct non-empty statement titles of each day in order of
    appearance, and how many of them there are (at most ``k``)."""
    named = events.where((F.col("category") == "bayanat") & (F.coalesce("title", F.lit("")) != ""))
    first = named.groupBy("date", "title").agg(F.min("id").alias("first_id"))
    top = top_per_group(first, ["date"], [F.asc("first_id")], k, "r")
    return top.groupBy("date").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]).alias("targets")
    )


def _number(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast("string")


def month_headline(targets: Column, statements: Column, alerts: Column) -> Column:
    """Headline of a day from its first distinct targets and counters.
    Fixed sentence forms."""
    n = F.size(targets)
    first, second, third = (F.get(targets, F.lit(i)) for i in range(3))
    said = F.concat(_number(statements), F.lit(" بيان عسكري"))
    warned = F.concat(_number(alerts), F.lit(" صفارة إنذار"))
    return (
        F.when(n >= 3, F.concat(F.lit("استهداف "), first, F.lit(" و"), second, F.lit(" و"), third))
        .when(n == 2, F.concat(F.lit("استهداف "), first, F.lit(" و"), second))
        .when((n == 1) & (F.coalesce(alerts, F.lit(0)) >= 10), F.concat(F.lit("استهداف "), first, F.lit(" — "), warned))
        .when(n == 1, F.concat(F.lit("استهداف "), first, F.lit(" — "), said))
        .when(F.coalesce(alerts, F.lit(0)) >= 15, F.concat(warned, F.lit(" — "), said))
        .otherwise(F.concat(said, F.lit(" — "), warned))
    )


def month_prose(targets: Column, statements: Column, alerts: Column, media: Column) -> Column:
    """Prose of a day, plain text."""
    positive = [F.coalesce(c, F.lit(0)) > 0 for c in (statements, alerts, media)]
    return F.concat_ws(
        " ",
        F.when(positive[0] & (F.size(targets) > 0), F.concat(
            F.lit("المقاومة تستهدف "), F.array_join(F.slice(targets, 1, 3), " و"), F.lit(" بالأسلحة الصاروخية والمدفعية."))),
        F.when(positive[0], F.concat(_number(statements), F.lit(" بيان عسكري صدر في هذا اليوم."))),
        F.when(positive[1], F.concat(_number(alerts), F.lit(" صفارة إنذار دوّت في مستوطنات الشمال."))),
        F.when(positive[2], F.concat(F.lit("إعلام العدو تناول "), _number(media), F.lit(" خبراً عن تداعيات العمليات."))),
    )


def month_brief(
    targets: Column, weapons: Column, alerts: Column, peak_alerts: Column, media: Column, allies: Column,
    state: Column, change: Column,
) -> Column:
    """Brief of a month from its ranked targets and weapons, counters,
    peak and trend; plain text."""
    n = F.size(targets)
    joined = F.array_join(F.slice(targets, 1, 3), " و")
    above = [F.coalesce(c, F.lit(0)) > 0 for c in (alerts, media, allies, state)]
    return F.concat_ws(
        " ",
        F.when(change >= TREND_LIMIT, F.lit(MONTH_RISE)).when(change <= -TREND_LIMIT, F.lit(MONTH_FALL)),
        F.when(n >= 1, F.concat(F.lit("ركّزت المقاومة عملياتها على "), joined, F.lit("،")))
        .otherwise(F.lit("واصلت المقاومة عملياتها على طول الجبهة،")),
        F.when(F.size(weapons) >= 1, F.concat(F.lit("باستخدام "), F.get(weapons, F.lit(0)), F.lit(" بشكل رئيسي.")))
        .otherwise(F.lit("بالأسلحة الصاروخية والمدفعية.")),
        F.when(above[0] & (peak_alerts >= 15), F.concat(
            F.lit("صفارات الإنذار لم تتوقف في مستوطنات الشمال، وبلغت ذروتها بـ"), peak_alerts.cast("string"), F.lit(" صفارة في يوم واحد.")))
        .when(above[0], F.lit("صفارات الإنذار دوّت في مستوطنات الشمال بشكل متواصل.")),
        F.when(above[1], F.lit("إعلام العدو رصد تداعيات العمليات على مدى الشهر.")),
        F.when(above[2] & above[3], F.lit("جبهات الإسناد والمحور الإيراني كانا حاضرين في المشهد."))
        .when(above[2], F.lit("جبهات الإسناد شاركت في العمليات خلال الشهر.")),
    )


def _ranked_lists(events: DataFrame, column: str, name: str, k: int = 3) -> DataFrame:
    ranked = K.month_top_values(events.where(F.col("category") == "bayanat"), column, k)
    return ranked.groupBy("month").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias(name)
    )


def month_summary(reports: DataFrame, events: DataFrame, counters: Sequence[str] = CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """Q8: ``(months, days)``: one row per month, and its top days.

    ``reports`` has one row per day; everything after the first aggregates is
    bounded by the calendar."""
    months = month_trend(K.month_totals(reports, counters))
    order = prev_next(months.select("month"), "month")
    parts = (
        months.join(order, "month")
        .join(_ranked_lists(events, "title", "targets"), "month", "left")
        .join(_ranked_lists(events, "subtitle", "weapons"), "month", "left")
        .join(K.peak_day(reports, "sirens"), "month", "left")
    )
    none = F.array().cast("array<string>")
    described = parts.withColumn("targets", F.coalesce("targets", none)).withColumn("weapons", F.coalesce("weapons", none)).withColumn(
        "brief",
        month_brief(F.col("targets"), F.col("weapons"), F.col("sirens"), F.col("peak"), F.col("enemy"), F.col("allies"),
                    F.col("iran"), F.col("change")),
    ).withColumn("ordinal", month_ordinal(F.col("month")))
    days = top_days_in_order(reports).join(day_targets(events), "date", "left")
    targets = F.coalesce("targets", none)
    label = F.coalesce(pick(POINT_LABELS, F.col("number")), F.concat(F.lit(POINT_FALLBACK), F.col("number").cast("string")))
    points = days.select(
        "month", "date", "number", label.alias("label"), "total", K.dominant_category(counters).alias("dominant"),
        month_headline(targets, F.col("bayanat"), F.col("sirens")).alias("headline"),
        month_prose(targets, F.col("bayanat"), F.col("sirens"), F.col("enemy")).alias("prose"),
    )
    return described, points
