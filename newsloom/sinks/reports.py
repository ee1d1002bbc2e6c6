"""Daily documents and the derived table sets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import localised_date, localised_day_name
from newsloom.operators.scale import PART_SIZE
from newsloom.schemas import REPORT, REPORT_ARRAYS, SHORT_COUNTERS
from newsloom.session import stage_table
from newsloom.sources.reports import read_manifest

# Members of a document item ← columns of the item table.
MEMBERS = {
    "bayanat": {"num": "num", "postTime": "time", "opTime": "op_time", "target": "target", "weapon": "weapon",
                "badge": "badge", "tags": "tags", "bayan_type": "bayan_type", "fullText": "text", "strikes": "strikes"},
    "sirens": {"time": "time", "location": "location", "fullText": "text"},
    "enemy": {"time": "time", "summary": "summary", "fullText": "text"},
    "iran": {"time": "time", "source": "source", "summary": "summary", "fullText": "text"},
    "videos": {"time": "time", "description": "description", "fullText": "text"},
    "allies": {"flag": "flag", "time": "time", "summary": "summary", "fullText": "text"},
    "summaries": {"time": "time", "kind": "kind", "summary": "summary", "fullText": "text"},
}


def day_documents(
    items: DataFrame, headers: DataFrame, points: DataFrame | None = None, part_size: int = PART_SIZE
) -> DataFrame:
    """Nested day documents from numbered items (``position`` inside day and
    category). Columns of ``schemas.REPORT`` and ``schemas.PARTS``.

    A document holds at most ``part_size`` items per category; a larger day
    continues in further parts, so no task has to build an unbounded row.
    ``first_position`` is the position of a part's first items; readers use it.
    Counters always describe the whole day.
    """
    used = sorted({c for m in MEMBERS.values() for c in m.values()})
    slim = items.select("date", "category", "position", *used).withColumn(
        "part", F.floor(F.col("position") / part_size).cast("int")
    )
    lists = slim.groupBy("date", "category", "part").agg(
        F.array_sort(F.collect_list(F.struct("position", *used))).alias("list"), F.count(F.lit(1)).alias("n")
    )

    def members(category: str) -> Column:
        chosen = F.max(F.when(F.col("category") == category, F.col("list")))
        mapped = F.transform(chosen, lambda x: F.struct(*[x[c].alias(m) for m, c in MEMBERS[category].items()]))
        return F.coalesce(mapped, F.array().cast(REPORT[category].dataType)).alias(category)

    counts = slim.groupBy("date").agg(
        *[F.count(F.when(F.col("category") == c, 1)).cast("int").alias(c) for c in REPORT_ARRAYS]
    ).select(
        "date", F.struct(*REPORT_ARRAYS, *[F.lit(None).cast("int").alias(s) for s in SHORT_COUNTERS.values()]).alias("stats")
    )
    days = lists.groupBy("date", "part").agg(*[members(c) for c in REPORT_ARRAYS])
    if points is None:
        days = days.withColumn("sirenPoints", F.array().cast(REPORT["sirenPoints"].dataType))
    else:
        # Points may need more parts than the items do.
        days = days.join(points, ["date", "part"], "full_outer").withColumns(
            {c: F.coalesce(c, F.array().cast(REPORT[c].dataType)) for c in ("sirenPoints", *REPORT_ARRAYS)})
    return (
        days.join(counts, "date", "left").join(headers, "date", "left")
        .select(
            F.date_format("date", "yyyy-MM-dd").alias("date"),
            localised_day_name(F.col("date")).alias("dayAr"), localised_date(F.col("date")).alias("dateAr"),
            F.coalesce("hijri", F.lit("")).alias("hijri"), "stats",
            "bayanat", "sirens", "sirenPoints", "enemy", "iran", "videos", "allies", "summaries", "part",
            (F.col("part").cast("long") * part_size).alias("first_position"),
        )
    )


def point_lists(points: DataFrame) -> DataFrame:
    """Alert points of each day as one list, most frequent first. The number of
    points of a day is bounded by the gazetteer."""
    entry = F.struct((-F.col("count")).alias("o"), F.col("first_position").alias("p"), "lat", "lng", "loc", "times", "count")
    listed = points.groupBy("date", "part").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    return listed.select(
        "date", "part",
        F.transform("l", lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng"), x["loc"].alias("loc"),
                                            x["times"].alias("times"), x["count"].cast("int").alias("count")))
        .alias("sirenPoints"),
    )


def write_day_documents(documents: DataFrame, path: str) -> None:
    """One folder per day. Days that are written replace those of the same
    date; all other days stay, so an incremental run only adds to the archive."""
    (
        documents.withColumn("day", F.col("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("day").json(path)
    )


def write_event_tables(events: DataFrame, reports: DataFrame, path: str) -> None:
    """Full rebuild of both tables; events are clustered by day, so date
    filters read only the folders of the range. The rebalance hint lets a day
    with very many events be written by many tasks."""
    events.hint("rebalance", F.col("date")).write.mode("overwrite").partitionBy("date").parquet(f"{path}/events")
    reports.write.mode("overwrite").parquet(f"{path}/reports")


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Named result sets under one folder. An empty result still
    writes its schema (parquet) or header (csv)."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{path}/{name}")


def write_repaired(documents: DataFrame, target: str, dry_run: bool = False) -> None:
    """Repaired documents go to a new path, never over their own input."""
    if not dry_run:
        documents.write.mode("errorifexists").json(target)


def write_run(documents: DataFrame, root: str) -> str:
    """Documents as a run of their own under ``root/data``, one folder per day. No
    reader looks at a run before ``publish_run``. Returns its name."""
    run = uuid.uuid4().hex
    documents.withColumn("day", F.col("date")).write.mode("errorifexists").partitionBy("day").json(f"{root}/data/run={run}")
    return run


def publish_run(spark: SparkSession, root: str, run: str) -> None:
    """A new manifest in which the days of ``run`` are taken from it and all
    others from where they were. A manifest is one row per calendar day and counts
    only when all its rows are there; until then readers keep the one before, and a
    repeated call replaces a part that a crash left. One writer at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/data/run={run}").select("path")  # names only
    new = files.select(F.regexp_extract("path", r"/day=([^/]+)/", 1).alias("day")).distinct().withColumn("run", F.lit(run))
    number, old = read_manifest(spark, root)
    rows = new if old is None else new.unionByName(old.join(new.select("day"), "day", "left_anti"))
    rows = stage_table(rows, "manifest")
    rows.withColumn("days", F.lit(rows.count())).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/number={number + 1}")


def publish_days(documents: DataFrame, root: str) -> None:
    """Replace the days of ``documents`` in the published state; other days keep
    their files."""
    publish_run(documents.sparkSession, root, write_run(documents, root))
