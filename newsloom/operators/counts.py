"""Dashboard aggregations.

All of them aggregate on low-cardinality keys, so map-side partial aggregation
reduces even a very hot key to one row per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.dates import day_phase, dow_of, hour_of, period_key
from newsloom.functions.geo import percent
from newsloom.operators.events import valid_time
from newsloom.operators.scale import top_per_group
from newsloom.rules import contains_any
from newsloom.schemas import CATEGORIES


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def small_table(df: DataFrame, values: Sequence, column: str) -> DataFrame:
    """A fixed short list as a table (category order, hours of the day)."""
    spark = df.sparkSession
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], [column, "ordinal"])


def kpi_counts(events: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Count per category in fixed order; an absent category counts 0."""
    row = events.agg(*[count_if(F.col("category") == c).alias(c) for c in categories])
    pairs = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("category"), F.col(c).alias("n")) for i, c in enumerate(categories)])
    return row.select(F.inline(pairs))


def kpi_ranked(events: DataFrame) -> DataFrame:
    """D1 as exported: present categories, largest first."""
    return events.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def daily_pivot(
    events: DataFrame, categories: Sequence[str] = CATEGORIES, total_of: Sequence[str] | None = None
) -> DataFrame:
    """One row per day with a count per category and the total. The total
    counts all rows unless ``total_of`` names the categories."""
    total = F.count(F.lit(1)) if total_of is None else count_if(F.col("category").isin(*total_of))
    return events.groupBy("date").agg(
        *[count_if(F.col("category") == c).alias(c) for c in categories], total.alias("total")
    )


def time_series(events: DataFrame, grouping: str, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """D3: dense period × category matrix.

    Rows are first counted per day: the period text is then built for one row
    per day instead of for every event."""
    daily = events.groupBy("date").agg(*[count_if(F.col("category") == c).alias(c) for c in categories])
    return daily.groupBy(period_key(F.col("date"), grouping).alias("period")).agg(
        *[F.sum(c).alias(c) for c in categories]
    )


def hour_dow_heatmap(events: DataFrame) -> DataFrame:
    """Hour × weekday (0 = Sunday)."""
    timed = events.where(valid_time(F.col("time")))
    return timed.groupBy(hour_of(F.col("time")).alias("hour"), dow_of(F.col("date")).alias("dow")).agg(
        F.count(F.lit(1)).alias("count")
    )


def heatmap_margins(events: DataFrame) -> DataFrame:
    """Cells with their day, hour and grand totals and shares. The cells
    (at most 24 × 7) are counted once; the margins are windows over them."""
    return with_margins(hour_dow_heatmap(events))


def with_margins(cells: DataFrame) -> DataFrame:
    """D5 from counted cells (``hour, dow, count``)."""
    everything = Window.partitionBy(F.lit(1))
    total, peak = F.sum("count").over(everything), F.max("count").over(everything)
    return cells.select(
        "hour", "dow", "count",
        F.sum("count").over(Window.partitionBy("dow")).alias("day_total"),
        F.sum("count").over(Window.partitionBy("hour")).alias("hour_total"),
        total.alias("grand_total"), peak.alias("peak"),
        percent(F.col("count"), total, 1).alias("share"),
        F.round(100.0 * F.col("count") / peak).cast("long").alias("share_of_peak"),
    )


def hour_density(events: DataFrame, dense: bool = False) -> DataFrame:
    """Events per hour; ``dense`` adds the hours without events."""
    timed = events.where(valid_time(F.col("time")))
    hourly = timed.groupBy(hour_of(F.col("time")).alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    if not dense:
        return hourly
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(hourly, "hour", "left").select("hour", F.coalesce("count", F.lit(0)).alias("count"))


def top_values(events: DataFrame, column: str = "title", k: int = 10, category: str | None = None) -> DataFrame:
    """Most frequent non-empty values; ties by value."""
    rows = events if category is None else events.where(F.col("category") == category)
    return (
        rows.where(F.col(column) != "").groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("value"))
        .orderBy(F.desc("value"), "name").limit(k)
    )


def most_active_days(events: DataFrame, k: int = 20) -> DataFrame:
    """D8."""
    return events.groupBy("date").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "date").limit(k)


def date_extent(rows: DataFrame) -> DataFrame:
    """D10."""
    return rows.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """D11."""
    counted = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = counted[0]
    for extra in counted[1:]:
        out = out.unionByName(extra)
    return out


def most_common(rows: DataFrame, column: str, position: Column, k: int | None = None) -> DataFrame:
    """values by count, ties by first appearance (``position``)."""
    ranked = (
        rows.where(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_position"))
        .orderBy(F.desc("n"), "first_position")
    )
    return ranked if k is None else ranked.limit(k)


# -- months -----------------------------------------------------------------------


def month_totals(reports: DataFrame, counters: Sequence[str] = CATEGORIES) -> DataFrame:
    """Counters summed per month, with the number of days."""
    total = sum((F.col(c) for c in counters[1:]), F.col(counters[0]))
    sums = reports.groupBy(F.trunc("date", "MM").alias("month")).agg(
        *[F.sum(c).cast("long").alias(c) for c in counters], F.countDistinct("date").alias("days")
    )
    return sums.withColumn("total", total)


def dominant_category(counters: Sequence[str] = CATEGORIES) -> Column:
    """Category with the largest counter of a row; ties keep the first."""
    ranked = F.array_max(
        F.array(*[F.struct(F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(counters)])
    )
    return ranked["c"]


def month_top_values(events: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The most frequent values of a column in each month; ties by value."""
    counted = (
        events.where(F.trim(column) != "")
        .groupBy(F.trunc("date", "MM").alias("month"), F.trim(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_per_group(counted, ["month"], [F.desc("n"), F.asc("value")], k)


def peak_day(reports: DataFrame, counter: str) -> DataFrame:
    """Per month the day with the largest counter; ties keep the earliest."""
    early = -F.datediff("date", F.lit("1970-01-01").cast("date"))
    return reports.groupBy(F.trunc("date", "MM").alias("month")).agg(
        F.max_by("date", F.struct(F.col(counter), early)).alias("peak_date"), F.max(counter).cast("long").alias("peak")
    )


# -- per-day and per-type counts ----------------------------------------------------


def phase_counts(events: DataFrame, *times: str) -> DataFrame:
    """Rows per day and part of the day; empty parts are omitted."""
    return events.groupBy("date", day_phase(*[F.col(t) for t in times]).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


def headline_counts(
    events: DataFrame, tank: Column, hit: Column, aircraft: Column, settlement: Column, base: Column,
    statement: Column, alert: Column,
) -> DataFrame:
    """The headline numbers of each day, one pass."""
    return events.groupBy("date").agg(
        count_if(statement).alias("statements"), count_if(statement & hit).alias("hits"),
        count_if(statement & tank).alias("tanks"), count_if(statement & aircraft).alias("aircraft"),
        count_if(statement & settlement).alias("settlements"), count_if(statement & base).alias("bases"),
        count_if(alert).alias("alerts"),
    )


def result_category_counts(results: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """D30."""
    return kpi_counts(results, categories)


def duplicates(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values that occur more than once inside a group."""
    return rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def quality_rates(rows: DataFrame, **conditions: Column) -> DataFrame:
    """Share of rows for which each condition holds (4 decimals)."""
    return rows.agg(*[F.round(F.avg(c.cast("int")), 4).alias(n) for n, c in conditions.items()])


def yearly_type_pivot(rows: DataFrame, type_column: str, types: Sequence[str], items: Column) -> DataFrame:
    """Year × type counts and the uplift of nested items over rows."""
    nested = F.coalesce(items, F.lit(0))
    return rows.groupBy(F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[count_if(F.col(type_column) == t).alias(t) for t in types],
        F.sum(F.when(nested > 0, nested - 1).otherwise(0)).cast("long").alias("uplift"),
    )


def type_dashboard(rows: DataFrame, label: Column, k: int | None = None) -> DataFrame:
    """Counts of one label, largest first, ties by label."""
    counted = rows.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n")).where(F.col("label").isNotNull())
    ranked = counted.orderBy(F.desc("n"), "label")
    return ranked if k is None else ranked.limit(k)


def multi_label_counts(rows: DataFrame, labels: Column) -> DataFrame:
    """A row counts once for each of its labels."""
    return rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def operation_class(badge: Column, title: Column, tank: str, bases: Sequence[str], aircraft: Sequence[str]) -> Column:
    """Exclusive operation class by priority."""
    return (
        F.when((badge == "tank") | title.contains(tank), "tank")
        .when(badge == "settlement", "settlement")
        .when((badge == "deep") | contains_any(title, bases), "base")
        .when(contains_any(title, aircraft), "air")
        .otherwise("troops")
    )
