"""Registry of the catalogue queries and the shared views of the given tables.

The event table stands in for the archive: its type is the category, its time
the post time, its user the title. Message, statement and report texts are
derived from the tables by Spark, so every query grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.scale import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KINDS = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL if it has one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are about to get expensive text work."""
    return spread(table(spark, folder, name))


def events(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """``id, date, category, time, title, user_id, value, ts``."""
    ts = F.col("ts").cast("timestamp_ntz")
    read = text_table if heavy else table
    return read(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.to_date(ts).alias("date"), F.col("event_type").alias("category"),
        F.concat(F.lpad(F.hour(ts).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.minute(ts).cast("string"), 2, "0")).alias("time"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("title"), "user_id", "value", ts.alias("ts"), "props",
    )


EV = (
    "(SELECT event_id AS id, CAST(ts AS DATE) AS date, event_type AS category, strftime(ts, '%H:%M') AS time, "
    "'u' || user_id AS title, user_id, value, ts, props FROM events)"
)


def sum_case(column: str, values, cast: str = "BIGINT") -> str:
    return ", ".join(f"CAST(sum(CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END) AS {cast}) AS {v}" for v in values)


def daily_reports(spark: SparkSession, folder: str) -> DataFrame:
    """One row per day: the counters of every kind and their total."""
    from newsloom.operators.counts import daily_pivot

    return daily_pivot(events(spark, folder), KINDS)


REPORTS = f"(SELECT date, {sum_case('category', KINDS)}, count(*) AS total FROM {EV} GROUP BY date)"
