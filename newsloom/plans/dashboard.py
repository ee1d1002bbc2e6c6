"""The dashboard's and the export's result sets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import dow_of, hour_of, period_key
from newsloom.operators import counts as K
from newsloom.operators.events import filter_events, page, page_count, raw_export, valid_time
from newsloom.schemas import CATEGORIES
from newsloom.session import stage_table
from newsloom.sinks.reports import write_tables

TABLE_CATEGORIES = CATEGORIES[:5]  # the table shows five; its total counts all


def dashboard_cells(rows: DataFrame, top_category: str = "bayanat") -> DataFrame:
    """All counts behind the dashboard in one scan and one shuffle:
    ``cells, date, category, hour, title, n`` with the cells ``day`` (per date and
    category), ``hour`` (per date and hour of the day) and ``title`` (non-empty
    titles of ``top_category``). Partial sums leave a task with one row per cell,
    so no date or title is hot; only titles grow with the data."""
    timed = F.when(valid_time(F.col("time")), hour_of(F.col("time")))
    named = F.when((F.col("category") == top_category) & (F.col("title") != ""), F.col("title"))
    keyed = rows.select("date", "category", timed.alias("hour"), named.alias("title"))
    keys = ("date", "category", "hour", "title")
    counted = keyed.groupingSets([["date", "category"], ["date", "hour"], ["title"]], *keys).agg(
        F.grouping("category").alias("no_category"), F.grouping("title").alias("no_title"), F.count(F.lit(1)).alias("n"))
    cells = F.when(F.col("no_title") == 0, "title").when(F.col("no_category") == 0, "day").otherwise("hour")
    used = (F.col("cells") == "day") | ((F.col("cells") == "hour") & F.col("hour").isNotNull()) | F.col("title").isNotNull()
    return counted.select(cells.alias("cells"), *keys, "n").where(used)


def dashboard(
    events: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
    categories: Sequence[str] | None = None, grouping: str = "daily", sort: str = "total",
    descending: bool = True, page_number: int = 1, page_size: int = 10, all_categories: Sequence[str] = CATEGORIES,
    table_categories: Sequence[str] = TABLE_CATEGORIES, top_category: str = "bayanat",
) -> dict[str, DataFrame]:
    """Q4: all panels for one filter state. The events are read once: their
    counted cells are staged, and every panel is a sum over cells."""
    cells = stage_table(dashboard_cells(filter_events(events, start, end, categories, all_categories), top_category), "dashboard")
    day, hour, titles = (cells.where(F.col("cells") == c) for c in ("day", "hour", "title"))

    def per_category(grouped, names: Sequence[str], total: bool = False) -> DataFrame:
        sums = [F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0)).alias(c) for c in names]
        return grouped.agg(*sums, *([F.sum("n").alias("total")] if total else []))

    shown = list(categories) if categories else list(all_categories)
    pairs = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("category"), F.col(c).alias("n")) for i, c in enumerate(all_categories)]
    heatmap = hour.groupBy("hour", dow_of(F.col("date")).alias("dow")).agg(F.sum("n").alias("count"))
    return {
        "kpis": per_category(day.groupBy(), all_categories).select(F.inline(F.array(*pairs))),
        "series": per_category(day.groupBy(period_key(F.col("date"), grouping).alias("period")), shown),
        "heatmap": heatmap,
        "heatmap_margins": K.with_margins(heatmap),
        "top_values": titles.select(F.col("title").alias("name"), F.col("n").alias("value")).orderBy(F.desc("value"), "name").limit(10),
        "table": page(per_category(day.groupBy("date"), table_categories, True), sort, descending, page_number, page_size,
                      ("date", *table_categories, "total")),
        "pages": page_count(day, page_size),
    }


def export_tables(events: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
                  categories: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Q6: the six result sets of the export."""
    rows = filter_events(events, start, end, categories)
    return {
        "kpis": K.kpi_ranked(rows),
        "events_over_time": K.daily_pivot(rows).drop("total").withColumnRenamed("date", "period").orderBy("period"),
        "hourly_density": K.hour_density(rows).orderBy("hour"),
        "most_active_days": K.most_active_days(rows, 20),
        "top_targets": K.top_values(rows, "title", 30, "bayanat").select(F.col("name").alias("target"), F.col("value").alias("count")),
        "raw_data": raw_export(rows),
    }


def export_report(events: DataFrame, path: str, start: dt.date, end: dt.date,
                  categories: Sequence[str] | None = None, fmt: str = "csv") -> None:
    """The sets under one folder that carries the date range."""
    write_tables(export_tables(events, start, end, categories), f"{path}/{start}_{end}", fmt)
