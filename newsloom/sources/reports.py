"""Daily report documents → typed tables."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import empty_to_null
from newsloom.schemas import CATEGORIES, PARTS, REPORT, SHORT_COUNTERS
from newsloom.session import stage_table

POSITION_BITS = 40  # room for positions inside one (day, category): 10 ** 12


def read_reports(spark: SparkSession, path: str, pattern: str = "????-??-??.json") -> DataFrame:
    """One row per daily document, plus ``file_date`` from the file
    name and ``_corrupt_record`` for documents that do not parse."""
    schema = T.StructType(REPORT.fields + PARTS.fields + [T.StructField("_corrupt_record", T.StringType())])
    raw = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("pathGlobFilter", pattern)
        .json(path)
    )
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return raw.withColumn("file_date", name)


def read_written_reports(spark: SparkSession, path: str) -> DataFrame:
    """Documents as ``write_day_documents`` leaves them: one folder per day, one
    document per line; the folder gives ``file_date``."""
    schema = T.StructType(REPORT.fields + PARTS.fields + [T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(T.StructType(schema.fields + [T.StructField("day", T.StringType())])).option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.withColumnRenamed("day", "file_date")


def read_manifest(spark: SparkSession, root: str) -> tuple[int, DataFrame | None]:
    """The latest complete manifest of ``root``: its number and ``day, run``; (0, None) without one."""
    try:
        rows = spark.read.schema("day string, run string, days bigint, number bigint").parquet(f"{root}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    whole = rows.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.max("days").alias("days")).where("n = days")
    number = whole.agg(F.max("number")).first()[0]
    return (0, None) if number is None else (number, rows.where(F.col("number") == number).select("day", "run"))


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """Documents of the published state, with ``file_date`` and ``run``; runs without a
    manifest and replaced days are not read."""
    _, manifest = read_manifest(spark, root)
    if manifest is None:
        raise ValueError(f"nothing is published under {root}")
    schema = T.StructType(REPORT.fields + PARTS.fields + [T.StructField(c, T.StringType()) for c in ("_corrupt_record", "run", "day")])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{root}/data")
    return rows.join(F.broadcast(manifest), ["run", "day"], "left_semi").withColumnRenamed("day", "file_date")  # a row per calendar day


def part_number(reports: DataFrame) -> Column:
    return F.coalesce("part", F.lit(0)) if "part" in reports.columns else F.lit(0)


def first_position(reports: DataFrame) -> Column:
    """Position of a document's first items inside their day."""
    return F.coalesce("first_position", F.lit(0)).cast("long") if "first_position" in reports.columns else F.lit(0).cast("long")


def with_day_lengths(reports: DataFrame, key: str = "file_date", arrays: tuple[str, ...] = (*CATEGORIES, "sirenPoints")) -> DataFrame:
    """Adds ``__n_<array>``, the array lengths of the whole day, and ``__has_<array>``,
    whether any document of the day has the array. Only a table with parts
    needs the sums; they are one narrow row per day."""
    sizes = {f"__n_{c}": array_length(c) for c in arrays} | {f"__has_{c}": F.col(c).isNotNull() for c in arrays}
    if "part" not in reports.columns:
        return reports.withColumns(sizes)
    # The condition is always true; it names a data column, because Spark does
    # not read JSON for the column of unreadable records alone.
    sums = reports.groupBy(F.col(key).alias("__key")).agg(
        *[F.sum(v).cast("int").alias(n) if n.startswith("__n") else F.max(v).alias(n) for n, v in sizes.items()],
        F.max(F.coalesce("hijri", F.lit(""))).alias("__any"),
    ).where("__any >= ''").drop("__any")
    return reports.join(sums, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def read_reports_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Any file name that starts with ``20``; the date falls back to it."""
    rows = read_reports(spark, path, "20*.json")
    return rows.withColumn("date", F.coalesce(empty_to_null(F.col("date")), F.substring("file_date", 1, 10)))


def document_fault(named: Column) -> Column:
    """A10, V1: what is wrong with a document: ``unreadable``, ``undated`` (neither it
    nor its file name, ``named``, has a date) or ``misnamed`` (they have different ones); else null."""
    own = F.col("date").try_cast("date")
    return (
        F.when(F.col("_corrupt_record").isNotNull(), "unreadable")
        .when(F.coalesce(own, named).isNull(), "undated").when(named.isNotNull() & own.isNotNull() & (own != named), "misnamed")
    )


def quarantine(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, set_aside)`` of documents as the readers return them.
    Files are read once and written to two sides. A good document has its date, if
    need be from the file name; one set aside has ``fault``, and an unreadable one
    its text in ``_corrupt_record``."""
    dated = reports.withColumn("fault", document_fault(report_day("file_date")))
    dated = dated.withColumns({"date": F.coalesce(empty_to_null(F.col("date")), F.substring("file_date", 1, 10)),
                               "side": F.when(F.col("fault").isNull(), "good").otherwise("aside")})
    sides = stage_table(dated, "documents", "side")
    good, aside = (sides.where(F.col("side") == name).drop("side") for name in ("good", "aside"))
    return good.drop("fault", "_corrupt_record"), aside


def report_day(column: str = "file_date") -> Column:
    return F.to_date(F.try_to_timestamp(F.substring(column, 1, 10), F.lit("yyyy-MM-dd")))


def scan_date_range(rows: DataFrame, start: dt.date, end: dt.date, column: str = "date") -> DataFrame:
    """Inclusive; on a table partitioned by day this prunes partitions."""
    if end < start:
        raise ValueError("end must not be before start")
    return rows.where(F.col(column).between(F.lit(start), F.lit(end)))


def scan_month(rows: DataFrame, year: int, month: int, column: str = "date") -> DataFrame:
    """The days of one month, as a range so that partitions are pruned."""
    first = dt.date(year, month, 1)
    after = dt.date(year + month // 12, month % 12 + 1, 1)
    return rows.where((F.col(column) >= F.lit(first)) & (F.col(column) < F.lit(after)))


def sql_over_tables(spark: SparkSession, tables: dict[str, DataFrame], text: str, args: dict | None = None) -> DataFrame:
    """Parametrised SQL over named tables."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return spark.sql(text, args=args or {})


def readable(reports: DataFrame) -> DataFrame:
    """A10: documents that parsed."""
    return reports.where(F.col("_corrupt_record").isNull()) if "_corrupt_record" in reports.columns else reports


def stored_counter(category: str, fallback: Column | None = None) -> Column:
    """Counter under its long or short key; null (or the fallback) if neither."""
    keys = [F.col(f"stats.{category}")]
    if category in SHORT_COUNTERS:
        keys.append(F.col(f"stats.{SHORT_COUNTERS[category]}"))
    return F.coalesce(*keys, *([fallback] if fallback is not None else []))


def array_length(category: str) -> Column:
    return F.coalesce(F.size(F.col(category)), F.lit(0))


def to_report_rows(reports: DataFrame, count_arrays: bool = False, totals: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """B2: header and counters of each day. ``count_arrays`` falls back to the
    array length where a counter is missing (day index), else to 0 (report
    table). ``totals`` names the categories of the total. Of a day in several
    parts the first one has the header; counters and lengths are the day's."""
    fallback = {c: F.col(f"__n_{c}") if count_arrays else F.lit(0) for c in CATEGORIES}
    whole = with_day_lengths(reports, "date") if count_arrays else reports
    counted = whole.where(part_number(reports) == 0).select(
        F.to_date("date").alias("date"), F.col("dayAr").alias("day_ar"), F.col("dateAr").alias("date_ar"), "hijri",
        *[stored_counter(c, fallback[c]).alias(c) for c in CATEGORIES],
    )
    total = sum((F.col(c) for c in totals[1:]), F.col(totals[0]))
    return counted.withColumn("total", total)


def event_id(day: Column, category_index: Column, position: Column) -> Column:
    """Unique id that orders events by day, category and position. It is
    computed per row, so no global numbering is needed."""
    days = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long")
    return F.shiftleft(days * 8 + category_index, POSITION_BITS) + position


def to_events(reports: DataFrame) -> DataFrame:
    """One canonical row per item of the six categories.

    All arrays of a document are joined into one and exploded once, so a report
    is read a single time. ``src_idx`` is the position inside (day, category).
    """

    def rows(category: str, mapping: dict[str, str]) -> Column:
        index = CATEGORIES.index(category)

        def row(item: Column, position: Column) -> Column:
            def field(name: str, dtype: str = "string") -> Column:
                source = mapping.get(name)
                return (item[source] if source else F.lit(None)).cast(dtype).alias(name)

            texts = [empty_to_null(field(n)).alias(n) for n in ("time", "op_time", "title", "subtitle", "badge")]
            return F.struct(
                F.lit(category).alias("category"), F.lit(index).alias("category_index"),
                (position.cast("long") + first_position(reports)).alias("src_idx"), *texts, field("num", "int"),
                field("tags", "array<string>"), empty_to_null(field("location")).alias("location"),
                empty_to_null(field("full_text")).alias("full_text"),
            )

        return F.coalesce(F.transform(F.col(category), row), F.array())

    # Which member of an item fills which event column.
    common = {"time": "time", "full_text": "fullText"}
    blocks = F.concat(
        rows("bayanat", {**common, "time": "postTime", "op_time": "opTime", "title": "target", "subtitle": "weapon",
                         "badge": "badge", "tags": "tags", "num": "num"}),
        rows("sirens", {**common, "title": "location", "location": "location"}),
        rows("enemy", {**common, "title": "summary"}),
        rows("iran", {**common, "title": "summary", "subtitle": "source"}),
        rows("videos", {**common, "title": "description"}),
        rows("allies", {**common, "title": "summary", "subtitle": "flag"}),
    )
    items = readable(reports).select(F.to_date("date").alias("date"), F.inline(blocks))
    return items.select(
        event_id(F.col("date"), F.col("category_index"), F.col("src_idx")).alias("id"),
        "date", "category", "time", "op_time", "title", "subtitle", "badge", "tags",
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"),
        "location", "full_text", "num", "src_idx",
    )


def report_points(reports: DataFrame) -> DataFrame:
    """Alert points of all days: ``date, position, loc, lat, lng, times, count``."""
    return readable(reports).select(F.to_date("date").alias("date"), F.posexplode("sirenPoints").alias("position", "p")).select(
        "date", "position", "p.loc", "p.lat", "p.lng", "p.times", "p.count"
    )
