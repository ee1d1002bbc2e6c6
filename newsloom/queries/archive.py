"""Dump, ingest, extraction, document and statistics queries.

The message texts are built from the event table in the written forms of the
archive, pass through the real parsers and extractors, and are compared with
the columns they were built from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.functions import extract as X
from newsloom.functions.text import norm_match
from newsloom.lexicon import statistics as V
from newsloom.operators import counts as K
from newsloom.operators.scale import PART_SIZE, collect_parts, id_bucket, pin
from newsloom.plans import facets as P
from newsloom.plans import ingest as I
from newsloom.plans import statistics as T
from newsloom.queries.base import EV, events, query, table
from newsloom.schemas import CATEGORIES, REPORT
from newsloom.session import stage_table, work_dir
from newsloom.sinks.dumps import day_dumps as to_day_dumps
from newsloom.sinks.dumps import format_record as record_line
from newsloom.sinks.dumps import write_day_dumps
from newsloom.sinks.dumps import merge_keep_larger as keep_larger
from newsloom.sinks.reports import day_documents as to_documents
from newsloom.sinks.reports import write_day_documents
from newsloom.sources import dumps as source
from newsloom.sources import reports as R
from newsloom.streaming.dumps import ingest_new_dumps

KIND_CATEGORY = {"purchase": "bayanat", "error": "sirens", "view": "enemy", "click": "videos", "signup": "other"}
STATEMENT_HEAD = "بيان صادر عن المقاومة الإسلامية ("


def messages(spark, folder):
    """One message per event; the text form depends on the event type."""
    rows = events(spark, folder, heavy=True)
    place = F.concat(F.lit("نقطة"), F.col("user_id").cast("string"))
    head = F.concat(F.lit(STATEMENT_HEAD), F.col("user_id").cast("string"), F.lit(")\n"))
    at = F.concat(F.lit("عند الساعة "), F.col("time"))
    form = F.col("user_id") % 4
    statement = (
        F.when(form == 0, F.concat(head, F.lit("استهدف المجاهدون "), at, F.lit(" موقع "), place, F.lit(" بصلية صاروخية.")))
        .when(form == 1, F.concat(head, F.lit("تصدى المجاهدون لمحاولة تسلّل "), at, F.lit(" عند أطراف بلدة "), place,
                                  F.lit(" بقذائف المدفعية. إصابة مباشرة وسقوط "), (F.col("user_id") % 7).cast("string"), F.lit(" جنود ودبابة.")))
        .when(form == 2, F.concat(head, F.lit("استهدف المجاهدون "), at, F.lit(" مستوطنة "), place, F.lit(" بصاروخ موجه.")))
        .otherwise(F.concat(F.lit("بيان صادر عن حزب الله\nحول مجازر "), place))
    )
    text = (
        F.when(F.col("category") == "purchase", statement)
        .when(F.col("category") == "error", F.concat(F.lit("#عاجل صفارات الإنذار تدوي في  "), place))
        .when(F.col("category") == "view", F.concat(F.lit("#إعلام_العدو\n\nالقناة 12: خبر "), F.col("props")))
        .when(F.col("category") == "click", F.concat(F.lit("بالفيديو | ⭕️ مشهد "), place, F.lit(" جودة عالية #فيديو")))
        .otherwise(F.concat(F.lit("خبر "), F.col("props")))
    )
    return rows.select("id", "date", "time", "ts", "user_id", "category", "value", text.alias("text"))


def items(spark, folder, staged: bool = False):
    """Classified and extracted messages of the event table. Queries that read
    them more than once take the staged form, as the ingest job does."""
    rows = I.extract_items(I.classify_messages(messages(spark, folder).drop("category")))
    return stage_table(rows, "items", partition_by="category") if staged else rows


def statements(spark, folder, staged: bool = False):
    rows = items(spark, folder, staged).where("category = 'bayanat'")
    return rows.withColumn("full_text", F.col("text"))


LINE = (
    "'ID: ' || id || ' | user ' || user_id || ' | Date: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00 | views:' || user_id || "
    "', forwards:' || (user_id % 3) || ' | Message: ' || category || ' ' || props"
)


def lines(spark, folder):
    rows = events(spark, folder)
    return rows.select(
        "id", "date",
        record_line(
            F.col("id"), F.concat(F.lit("user "), F.col("user_id").cast("string")), F.col("ts"),
            F.concat("category", F.lit(" "), "props"), views=F.col("user_id"), forwards=F.col("user_id") % 3,
        ).alias("record"),
    )


@query(f"SELECT id, {LINE} AS record FROM {EV}")
def format_record(spark, folder):
    return lines(spark, folder).select("id", "record")


@query(
    f"WITH l AS (SELECT date, id, {LINE} AS record, row_number() OVER (PARTITION BY date ORDER BY id) - 1 AS pos FROM {EV}) "
    "SELECT date, CAST(pos // 100 AS INTEGER) AS part, string_agg(record, chr(10) ORDER BY id) AS text FROM l GROUP BY 1, 2"
)
def day_dumps(spark, folder):
    return to_day_dumps(lines(spark, folder), part_size=100, width=64)


@query(
    f"SELECT id, date, time, date_trunc('second', ts) AS ts, 'user ' || user_id AS sender, user_id AS views, user_id % 3 AS forwards, category || ' ' || props AS text FROM {EV}"
)
def parse_record_header(spark, folder):
    parsed = source.parse_record_header(source.split_records(to_day_dumps(lines(spark, folder))))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz"))
    return parsed.select("id", "date", "time", utc.alias("ts"), "sender", "views", "forwards", "text")


@query(f"SELECT date, count(*) AS n, CAST(sum(length({LINE})) AS BIGINT) AS chars FROM {EV} GROUP BY date")
def split_by_day(spark, folder):
    weekly = lines(spark, folder).withColumn("week", F.trunc("date", "week"))
    dumps = collect_parts(weekly, ["week"], ["id"], [id_bucket("id")], F.col("record"), "records", 5_000)
    records = source.split_by_day(dumps.select("week", F.array_join("records", "\n").alias("text")))
    return records.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("record")).alias("chars"))


@query(f"SELECT date, count(*) AS records FROM {EV} GROUP BY date")
def count_raw_records(spark, folder):
    counted = source.count_raw_records(to_day_dumps(lines(spark, folder)))
    return counted.groupBy("date").agg(F.sum("records").alias("records"))


@query(f"SELECT date, count(*) AS records FROM {EV} WHERE date NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE dayofmonth(ts) % 2 = 0) GROUP BY date")
def skip_existing_days(spark, folder):
    rows = events(spark, folder)
    return source.planned_days(rows, rows.where(F.dayofmonth("date") % 2 == 0))


@query(
    f"WITH a AS (SELECT date, count(*) AS n FROM {EV} WHERE category IN ('click', 'view') AND dayofmonth(date) > 4 GROUP BY date), "
    f"b AS (SELECT date, count(*) AS n FROM {EV} WHERE category IN ('error', 'purchase') AND dayofmonth(date) < 26 GROUP BY date) "
    "SELECT date, CASE WHEN b.n IS NOT NULL AND b.n >= coalesce(a.n, 0) THEN b.n ELSE coalesce(a.n, 0) END AS records, "
    "CASE WHEN b.n IS NOT NULL AND b.n >= coalesce(a.n, 0) THEN 'new' ELSE 'old' END AS text, "
    "CASE WHEN b.n IS NULL THEN 'stored' WHEN b.n >= coalesce(a.n, 0) AND b.n >= 130 THEN 'OK' WHEN b.n >= coalesce(a.n, 0) THEN 'quiet-day' ELSE 'KEEP' END AS status "
    "FROM a FULL JOIN b USING (date)"
)
def merge_keep_larger(spark, folder):
    rows = events(spark, folder)

    def side(kinds, condition, label):
        chosen = rows.where(F.col("category").isin(*kinds) & condition)
        return chosen.groupBy("date").agg(F.count(F.lit(1)).alias("records")).withColumn("text", F.lit(label))

    old = side(("click", "view"), F.dayofmonth("date") > 4, "old")
    new = side(("error", "purchase"), F.dayofmonth("date") < 26, "new")
    return keep_larger(old, new, F.lit(130))


_CATEGORY = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND_CATEGORY.items()) + " END"


@query(f"SELECT id, {_CATEGORY} AS category FROM {EV}")
def classify_category(spark, folder):
    return I.classify_messages(messages(spark, folder).drop("category")).select("id", "category")


_PLACE = "'نقطة' || user_id"
_FORM = "user_id % 4"
_STATEMENTS = (
    f"(SELECT id, date, time, user_id, ts, value, {_FORM} AS form, "
    f"CASE {_FORM} WHEN 3 THEN 0 ELSE CAST(user_id AS INTEGER) END AS num, "
    f"CASE {_FORM} WHEN 0 THEN 'موقع ' || {_PLACE} WHEN 3 THEN 'بيان حول مجازر العدو بحق المدنيين' ELSE {_PLACE} END AS target, "
    f"CASE {_FORM} WHEN 0 THEN 'صلية صاروخية' WHEN 1 THEN 'قذائف مدفعية' WHEN 2 THEN 'صاروخ موجّه' ELSE '' END AS weapon, "
    f"CASE {_FORM} WHEN 1 THEN 'tank' WHEN 2 THEN 'settlement' WHEN 3 THEN 'communique' ELSE '' END AS badge, "
    f"CASE {_FORM} WHEN 1 THEN 'إصابة مباشرة' WHEN 3 THEN 'بيان عام' ELSE '' END AS tags, "
    f"CASE {_FORM} WHEN 1 THEN 'defensive' WHEN 3 THEN 'statement' ELSE 'offensive' END AS bayan_type, "
    f"CASE {_FORM} WHEN 3 THEN '' ELSE time END AS op_time FROM {EV} WHERE category = 'purchase')"
)


@query(f"SELECT id, num, target, weapon, badge, tags, bayan_type, op_time FROM {_STATEMENTS}")
def statement_fields(spark, folder):
    return statements(spark, folder).select(
        "id", "num", "target", "weapon", "badge", F.array_join("tags", ",").alias("tags"), "bayan_type", "op_time"
    )


@query(
    f"SELECT id, CASE category WHEN 'error' THEN 'في ' || {_PLACE} WHEN 'view' THEN 'القناة 12: خبر ' || props "
    f"ELSE 'بالفيديو | مشهد ' || {_PLACE} END AS value FROM {EV} WHERE category IN ('error', 'view', 'click')"
)
def media_and_alert_fields(spark, folder):
    rows = items(spark, folder).where(F.col("category").isin("sirens", "enemy", "videos"))
    return rows.select("id", F.coalesce("location", "summary", "description").alias("value"))


@query(
    "SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 2, '0') AS op_time, "
    "'موقع نقطة' || l_partkey AS target, CASE WHEN l_returnflag = 'R' THEN 'صلية صاروخية' ELSE 'قذائف مدفعية' END AS weapon, count(*) AS n FROM lineitem GROUP BY ALL"
)
def parse_list_items(spark, folder):
    """Nested items written into one statement per order, parsed out again."""
    line = F.concat(
        F.lit("- "), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(":"),
        F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0"), F.lit(" موقع نقطة"), F.col("l_partkey").cast("string"),
        F.when(F.col("l_returnflag") == "R", " بصلية صاروخية.").otherwise(" بقذائف المدفعية."),
    )
    rows = table(spark, folder, "lineitem")
    listed = collect_parts(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_linenumber"], line, "lines", 20)
    text = F.concat(F.lit(STATEMENT_HEAD + "1)\nاستهدف المجاهدون مواقع العدو على النحو الآتي:\n"), F.array_join("lines", "\n"))
    texts = pin(listed.select("l_orderkey", text.alias("text")), normal=norm_match(F.col("text")))
    found = X.list_item_rows(texts.withColumn("target", F.lit("")), "text", "target", "normal")
    return found.groupBy(
        "l_orderkey", F.substring("op_time", 1, 2).cast("int").alias("l_linenumber"), "op_time",
        F.col("item_target").alias("target"), F.col("item_weapon").alias("weapon"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH v AS (SELECT *, row_number() OVER (PARTITION BY date, time, user_id ORDER BY id) AS r FROM {EV} WHERE category = 'click') "
    "SELECT id FROM v WHERE r = 1"
)
def dedupe_media(spark, folder):
    return I.dedupe_media(items(spark, folder, staged=True)).where("category = 'videos'").select("id")


def documents(spark, folder, part_size=PART_SIZE):
    kept = items(spark, folder, staged=True).where(F.col("category") != X.OTHER)
    numbered = I.number_items(kept)
    return to_documents(numbered, I.day_headers(messages(spark, folder)), part_size=part_size)


_SRC = f"(SELECT *, {_CATEGORY} AS cat, row_number() OVER (PARTITION BY date, category ORDER BY id) - 1 AS src_idx FROM {EV} WHERE category <> 'signup')"
_TITLE = (
    f"CASE category WHEN 'purchase' THEN CASE {_FORM} WHEN 0 THEN 'موقع ' || {_PLACE} WHEN 3 THEN 'بيان حول مجازر العدو بحق المدنيين' ELSE {_PLACE} END "
    f"WHEN 'error' THEN 'في ' || {_PLACE} WHEN 'view' THEN 'القناة 12: خبر ' || props ELSE 'بالفيديو | مشهد ' || {_PLACE} END"
)


_EVENT_ROWS = f"SELECT date, cat AS category, src_idx, time, {_TITLE} AS title FROM {_SRC}"


@query(_EVENT_ROWS)
def documents_to_events(spark, folder):
    """Items nested into day documents and flattened back into events."""
    return R.to_events(documents(spark, folder)).select("date", "category", "src_idx", "time", "title")


@query(f"SELECT *, true AS unique_ids FROM ({_EVENT_ROWS})")
def documents_to_events_parts(spark, folder):
    """The same from days split into documents of five items, with a check that
    no id comes twice."""
    rows = stage_table(R.to_events(documents(spark, folder, 5)), "part-events")
    unique = rows.groupBy("id").agg((F.count(F.lit(1)) == 1).alias("unique_ids"))
    return rows.join(unique, "id").select("date", "category", "src_idx", "time", "title", "unique_ids")


@query(_EVENT_ROWS)
def documents_written_in_two_runs(spark, folder):
    """Half of the days written, then the other half to the same place, and read
    back: a later run keeps the days of an earlier one."""
    path = f"{work_dir(spark)}/documents-{uuid.uuid4().hex}"
    days = stage_table(documents(spark, folder, 50), "documents")
    odd = F.dayofmonth(F.to_date("date")) % 2
    for half in (0, 1):
        write_day_documents(days.where(odd == half), path)
    return R.to_events(R.read_written_reports(spark, path)).select("date", "category", "src_idx", "time", "title")


@query(_EVENT_ROWS)
def ingest_to_events(spark, folder):
    """The whole way: dump files in the shared folder, messages, items, day
    documents written and read back, events."""
    path = f"{work_dir(spark)}/archive-{uuid.uuid4().hex}"
    rows = messages(spark, folder)
    lines_ = rows.select("id", "date", record_line(F.col("id"), F.lit("channel"), F.col("ts"), F.col("text"), views=F.col("user_id")).alias("record"))
    write_day_dumps(to_day_dumps(lines_), f"{path}/raw")
    write_day_documents(I.ingest_documents(spark, f"{path}/raw/*/*.json", part_size=50), f"{path}/data")
    return R.to_events(R.read_written_reports(spark, f"{path}/data")).select("date", "category", "src_idx", "time", "title")


def _written_archive(spark, folder, part_size):
    """All messages as dump files, a day in documents of ``part_size`` records."""
    path = f"{work_dir(spark)}/archive-{uuid.uuid4().hex}"
    rows = messages(spark, folder)
    lines_ = rows.select("id", "date", record_line(F.col("id"), F.lit("channel"), F.col("ts"), F.col("text"), views=F.col("user_id")).alias("record"))
    write_day_dumps(to_day_dumps(lines_, part_size), f"{path}/raw")
    return path


@query(_EVENT_ROWS)
def ingest_to_events_parts(spark, folder):
    """The same where each day's dump has many documents in one file, and the day
    documents are split too; with a gazetteer, so with alert points."""
    path = _written_archive(spark, folder, 50)
    write_day_documents(I.ingest_documents(spark, f"{path}/raw/*/*.json", user_places(spark, folder), part_size=50), f"{path}/data")
    return R.to_events(R.read_written_reports(spark, f"{path}/data")).select("date", "category", "src_idx", "time", "title")


def user_places(spark, folder):
    """The places that the messages name."""
    user = events(spark, folder).select("user_id").distinct()
    name = F.concat(F.lit("نقطة"), F.col("user_id").cast("string"))
    return user.select(name.alias("name"), (F.col("user_id") % 90).cast("double").alias("lat"), (F.col("user_id") % 180).cast("double").alias("lng"), F.lit(0).alias("priority"))


@query(
    "SELECT date, 'نقطة' || user_id AS loc, CAST(user_id % 90 AS DOUBLE) AS lat, CAST(user_id % 180 AS DOUBLE) AS lng, CAST(count(*) AS INTEGER) AS count, "
    f"string_agg(time, ',' ORDER BY id) AS times FROM {EV} WHERE category = 'error' GROUP BY date, user_id"
)
def ingest_alert_points(spark, folder):
    """Alert points of the whole way, read back from the day documents."""
    path = _written_archive(spark, folder, 50)
    write_day_documents(I.ingest_documents(spark, f"{path}/raw/*/*.json", user_places(spark, folder)), f"{path}/data")
    points = R.report_points(R.read_written_reports(spark, f"{path}/data"))
    return points.select("date", "loc", "lat", "lng", "count", F.array_join("times", ",").alias("times"))


@query(
    f"SELECT id, date, time, {_CATEGORY} AS category FROM {EV} WHERE category <> 'signup' "
    "QUALIFY category <> 'click' OR row_number() OVER (PARTITION BY date, time, category, user_id ORDER BY id % 2, id) = 1"
)
def ingest_stream(spark, folder):
    """Dumps that arrive in two lots, each taken by a stream run with the same
    checkpoint: no file is taken twice, and the second lot's copies of all videos
    are dropped, also those whose first one came with the first lot."""
    path = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = messages(spark, folder)
    for lot in (0, 1):
        arrived = rows.where(F.col("id") % 2 == lot)
        if lot:
            arrived = arrived.unionByName(rows.where("category = 'click'").withColumn("id", F.col("id") + 10**12))
        lines_ = arrived.select("id", "date", record_line(F.col("id"), F.lit("channel"), F.col("ts"), F.col("text"), views=F.col("user_id")).alias("record"))
        write_day_dumps(to_day_dumps(lines_), f"{path}/raw/lot={lot}")
        ingest_new_dumps(spark, f"{path}/raw/*/*/*.json", f"{path}/items", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/items").select("id", "date", "time", "category")


_PLANTED = "CASE WHEN dayofmonth(date) % 7 IN (0, 3) THEN 'unreadable' WHEN dayofmonth(date) % 7 = 2 THEN 'misnamed' ELSE '' END"


@query(
    f"SELECT strftime(date, '%Y-%m-%d') AS day, {_PLANTED} AS fault, CAST(sum(CASE WHEN dayofmonth(date) % 7 IN (0, 3) THEN 0 ELSE 1 END) AS BIGINT) AS items "
    f"FROM {EV} WHERE category <> 'signup' GROUP BY date"
)
def tolerant_documents(spark, folder):
    """Day documents with broken, undated and misnamed ones among them: good days
    go on to events, the others are set aside with the reason."""
    path = f"{work_dir(spark)}/tolerant-{uuid.uuid4().hex}"
    days = documents(spark, folder).withColumns({"day": F.col("date"), "k": F.dayofmonth(F.to_date("date")) % 7})
    days = days.withColumn("date", F.when(F.col("k") == 1, "").when(F.col("k") == 2, "1999-01-01").otherwise(F.col("date")))
    text = F.to_json(F.struct(*[c for c in days.columns if c not in ("day", "k")]))
    value = F.when(F.col("k") == 0, F.substring(text, F.lit(1), F.length(text) - 9)).when(F.col("k") == 3, "no document").otherwise(text)
    days.select(value.alias("value"), "day").write.partitionBy("day").text(path)
    good, aside = R.quarantine(R.read_written_reports(spark, path))
    lengths = sum((R.array_length(c) for c in CATEGORIES), F.lit(0)).cast("long")
    found = R.to_events(good).groupBy(F.date_format("date", "yyyy-MM-dd").alias("day"), F.lit("").alias("fault")).agg(F.count(F.lit(1)).alias("items"))
    return found.unionByName(aside.groupBy(F.col("file_date").alias("day"), "fault").agg(F.sum(lengths).alias("items")))


@query(f"SELECT date, count(*) AS records FROM {EV} GROUP BY date")
def count_records_in_files(spark, folder):
    """Records per day, counted in dump files of many documents."""
    path = _written_archive(spark, folder, 50)
    counted = source.count_file_records(spark, f"{path}/raw/*/*.json")
    return counted.groupBy(F.regexp_extract("file", r"date=([\d-]+)", 1).cast("date").alias("date")).agg(F.sum("records").alias("records"))


_REPORT_ROWS = (
    f"SELECT date, CAST(count(*) FILTER (WHERE cat = 'bayanat') AS INTEGER) AS bayanat, CAST(count(*) FILTER (WHERE cat = 'sirens') AS INTEGER) AS sirens, "
    f"CAST(count(*) FILTER (WHERE cat = 'enemy') AS INTEGER) AS enemy, 0 AS iran, CAST(count(*) FILTER (WHERE cat = 'videos') AS INTEGER) AS videos, 0 AS allies, CAST(count(*) AS INTEGER) AS total FROM {_SRC} GROUP BY date"
)


@query(_REPORT_ROWS)
def report_rows(spark, folder):
    return R.to_report_rows(documents(spark, folder)).drop("day_ar", "date_ar", "hijri")


@query(_REPORT_ROWS)
def report_rows_parts(spark, folder):
    """From split days, with the counters taken away: the lengths are summed."""
    split = documents(spark, folder, 5).withColumn("stats", F.lit(None).cast(REPORT["stats"].dataType))
    return R.to_report_rows(split, count_arrays=True).drop("day_ar", "date_ar", "hijri")


def archive_events(spark, folder):
    """Canonical event rows straight from the classified items."""
    rows = I.number_items(items(spark, folder, staged=True).where(F.col("category") != X.OTHER))
    return rows.select(
        "id", "date", "category", "time", "op_time", F.coalesce("target", "location", "summary", "description").alias("title"),
        F.col("weapon").alias("subtitle"), "badge", "tags", "location", F.col("text").alias("full_text"), "num",
        F.col("position").alias("src_idx"),
    )


@query(
    f"SELECT id, coalesce(nullif(CASE category WHEN 'purchase' THEN CASE {_FORM} WHEN 3 THEN '' ELSE time END ELSE '' END, ''), time) AS time, "
    f"CASE WHEN category IN ('purchase', 'error') THEN {_TITLE} ELSE substr({_TITLE}, 1, 80) END AS title, "
    f"CASE WHEN category = 'purchase' THEN 'بيان #' || CASE {_FORM} WHEN 3 THEN 0 ELSE user_id END ELSE '' END AS subtitle, src_idx, cat AS category, date FROM {_SRC}"
)
def search_entries(spark, folder):
    from newsloom.operators.events import search_entry

    return search_entry(archive_events(spark, folder)).drop("norm_text")


_WEAPON = "CASE form WHEN 0 THEN 'صلية صاروخية' WHEN 1 THEN 'قذائف مدفعية' WHEN 2 THEN 'صاروخ موجه' END"


_FACETS = (
    f"WITH i AS (SELECT id, {_WEAPON} AS weapon, CASE WHEN form <> 3 THEN target END AS target, nullif(badge, '') AS badge, CASE WHEN form = 1 THEN tags END AS tag FROM {_STATEMENTS}), "
    f"l AS (SELECT id, 'في ' || {_PLACE} AS location FROM {EV} WHERE category = 'error'), "
    "p AS (SELECT 'weapons' AS facet, weapon AS value, id FROM i UNION ALL SELECT 'targets', target, id FROM i UNION ALL SELECT 'badges', badge, id FROM i "
    "UNION ALL SELECT 'tags', tag, id FROM i UNION ALL SELECT 'locations', location, id FROM l), "
    "c AS (SELECT facet, value, count(*) AS n, min(id) AS first_id FROM p WHERE value IS NOT NULL GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, first_id) AS k FROM c) "
    "SELECT facet, value, n, first_id, CASE WHEN facet = 'badges' THEN CASE value WHEN 'communique' THEN 'بيان عام' WHEN 'tank' THEN 'آلية / دبابة' ELSE 'مستوطنة' END ELSE value END AS label "
    "FROM r"
)


@query(_FACETS)
def facet_counts(spark, folder):
    return P.facet_counts(P.facet_items(archive_events(spark, folder)))


@query(_FACETS + " WHERE k <= 300 OR facet NOT IN ('targets', 'locations')")
def facet_counts_page(spark, folder):
    """The page's report of the 300 most frequent targets and places."""
    return P.facet_counts(P.facet_items(archive_events(spark, folder)), P.CAPPED)


@query(
    f"WITH k AS (SELECT date, unnest([target, weapon, tags] || CASE form WHEN 1 THEN ['دبابة', 'قذائف'] || CASE WHEN false THEN [] ELSE ['مدفعية'] END WHEN 0 THEN ['صاروخ', 'صلية صاروخية'] WHEN 2 THEN ['صاروخ'] ELSE [] END) AS keyword FROM {_STATEMENTS} "
    f"UNION SELECT date, {_PLACE} FROM {EV} WHERE category = 'error' UNION SELECT date, 'القناة 12' FROM {EV} WHERE category = 'view') "
    "SELECT date, 0 AS part, string_agg(keyword, ' ' ORDER BY keyword) AS keywords FROM (SELECT DISTINCT date, keyword FROM k WHERE keyword <> '') GROUP BY date"
)
def day_keywords(spark, folder):
    return P.day_keywords(P.keyword_rows(archive_events(spark, folder)))


# -- statistics -----------------------------------------------------------------------

TOWNS = ("نقطة1",)
_OPS = (
    f"(SELECT date, id, form, form = 1 AS is_defensive, CASE form WHEN 0 THEN 'الأسلحة_الصاروخية' WHEN 1 THEN 'القذائف_المدفعية' ELSE 'الصواريخ_الموجهة' END AS family, "
    f"CASE WHEN contains(target, 'نقطة1') THEN 'تصدي_لعملية_تقدم' WHEN form = 2 THEN 'مدن_ومستوطنات' WHEN form = 0 THEN 'مواقع_حدودية_ومستحدثة' ELSE 'أخرى' END AS kind FROM {_STATEMENTS} WHERE form <> 3)"
)
_TOTALS = (
    f"(SELECT count(*) FILTER (WHERE form <> 1 AND kind <> 'تصدي_لعملية_تقدم') AS offensive_strikes, count(*) FILTER (WHERE form = 1) AS defensive_ops, "
    f"count(*) FILTER (WHERE form = 1 OR kind = 'تصدي_لعملية_تقدم') AS counter_advance, CAST(0 AS BIGINT) AS counter_landing, count(*) AS operations_distinct FROM {_OPS})"
)


def operations(spark, folder):
    return T.operation_rows(statements(spark, folder), TOWNS)


@query(f"SELECT offensive_strikes + defensive_ops + counter_advance AS operations, * FROM {_TOTALS}")
def operation_stats(spark, folder):
    return T.operation_totals(operations(spark, folder))


@query(f"SELECT 'target' AS dimension, kind AS bucket, count(*) AS n FROM {_OPS} GROUP BY 2 UNION ALL SELECT 'weapon', family, count(*) FROM {_OPS} GROUP BY 2")
def bucket_counts(spark, folder):
    return T.bucket_counts(operations(spark, folder))


@query(
    f"WITH d AS (SELECT date, count(*) AS n, count(*) FILTER (WHERE form <> 1 AND kind <> 'تصدي_لعملية_تقدم') + count(*) FILTER (WHERE form = 1) + count(*) FILTER (WHERE form = 1 OR kind = 'تصدي_لعملية_تقدم') AS p FROM {_OPS} GROUP BY date) "
    f"SELECT (SELECT count(DISTINCT date) FROM {EV}) AS days_scanned, count(*) AS active_days, CAST(printf('%.1f', sum(p) / count(*)) AS DOUBLE) AS daily_avg, "
    "(SELECT date FROM d ORDER BY n DESC, date LIMIT 1) AS max_date, max(n) AS max_count FROM d"
)
def activity_summary(spark, folder):
    return T.activity_summary(events(spark, folder).select("date"), operations(spark, folder))


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{label}', (SELECT count(*) FROM {_STATEMENTS} WHERE form = 1))" if label == "دبابات" else f"('{label}', CAST(0 AS BIGINT))"
        for label, _ in V.LOSS_RULES
    )
    + ") AS t(label, n)"
)
def mention_counts(spark, folder):
    return T.mention_counts(statements(spark, folder))


@query(f"SELECT CAST(sum(user_id % 7) AS BIGINT) AS total FROM {_STATEMENTS} WHERE form = 1")
def number_sum(spark, folder):
    return T.number_sum(statements(spark, folder))


@query(
    f"SELECT (SELECT min(date) FROM {EV}) AS from_date, (SELECT count(DISTINCT date) FROM {_OPS}) AS active_days, offensive_strikes + defensive_ops + counter_advance AS operations, "
    f"(SELECT count(*) FROM {_STATEMENTS} WHERE form = 3) AS statements_excluded, (SELECT count(*) FROM {_OPS} WHERE family = 'القذائف_المدفعية') AS artillery, "
    f"(SELECT count(*) FROM {_STATEMENTS} WHERE form = 1) AS vehicles FROM {_TOTALS}"
)
def range_statistics(spark, folder):
    doc = T.range_statistics(statements(spark, folder, staged=True), events(spark, folder).select("date"), TOWNS)
    return doc.select(
        F.col("period.from").alias("from_date"), F.col("period.active_days").alias("active_days"), F.col("totals.operations").alias("operations"),
        F.col("totals.statements_excluded").alias("statements_excluded"), F.col("weapons")["القذائف_المدفعية"].alias("artillery"),
        F.col("losses")["دبابات"].alias("vehicles"),
    )


# -- page dashboards ------------------------------------------------------------------


@query(f"SELECT CASE form WHEN 1 THEN 'tank' WHEN 2 THEN 'settlement' ELSE 'troops' END AS label, count(*) AS n FROM {_STATEMENTS} GROUP BY 1")
def statement_dashboard(spark, folder):
    label = K.operation_class(F.col("badge"), F.col("target"), V.TANK_WORD, V.BASE_WORDS, V.AIRCRAFT_WORDS)
    return K.type_dashboard(statements(spark, folder), label)


@query(f"SELECT CASE WHEN weapon = '' THEN 'أخرى' ELSE weapon END AS label, count(*) AS n FROM {_STATEMENTS} GROUP BY 1")
def statement_weapons(spark, folder):
    return K.type_dashboard(statements(spark, folder), F.coalesce(F.nullif("weapon", F.lit("")), F.lit(V.OTHER)))


@query(
    f"SELECT r.region AS label, count(*) AS n FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'حيفا' WHEN 1 THEN 'عكا' ELSE NULL END AS region FROM {EV} WHERE category = 'error') r WHERE r.region IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 9"
)
def alert_dashboard(spark, folder):
    from newsloom.functions.classify import keyword_label

    place = F.when(F.col("user_id") % 3 == 0, F.lit("قرب حيفا")).when(F.col("user_id") % 3 == 1, F.lit("شرق عكا")).otherwise("الساحل")
    rows = events(spark, folder).where("category = 'error'").withColumn("location", place)
    return K.type_dashboard(rows, keyword_label(F.col("location"), V.ALERT_REGIONS), 9)


@query(
    f"SELECT CASE user_id % 4 WHEN 0 THEN 'missiles' WHEN 1 THEN 'casualties' WHEN 2 THEN 'political' ELSE 'other' END AS label, count(*) AS n FROM {EV} WHERE category = 'view' GROUP BY 1"
)
def media_dashboard(spark, folder):
    from newsloom.functions.classify import keyword_label

    words = F.array(F.lit("سقوط صاروخ وقتيل"), F.lit("جرح جندي"), F.lit("نتنياهو يصرح"), F.lit("خبر"))
    rows = events(spark, folder).where("category = 'view'").withColumn("text", F.get(words, (F.col("user_id") % 4).cast("int")))
    return K.type_dashboard(rows, keyword_label(F.col("text"), V.MEDIA_TOPICS, F.lit("other")))


@query(
    f"WITH t AS (SELECT user_id % 2 = 0 AS a, user_id % 3 = 0 AS b, user_id % 5 = 0 AS c FROM {EV} WHERE category = 'view') "
    "SELECT 'irgc' AS label, count(*) AS n FROM t WHERE a UNION ALL SELECT 'army', count(*) FROM t WHERE b AND NOT a UNION ALL SELECT 'warnings', count(*) FROM t WHERE c UNION ALL SELECT 'missiles', count(*) FROM t WHERE a"
)
def multi_label_dashboard(spark, folder):
    from newsloom.functions.classify import keyword_label, keyword_labels

    user = F.col("user_id")
    text = F.concat_ws(
        " ", F.when(user % 2 == 0, F.lit("حرس الثورة: الموجة")), F.when(user % 3 == 0, F.lit("القوات المسلحة")), F.when(user % 5 == 0, F.lit("الملاجئ"))
    )
    rows = events(spark, folder).where("category = 'view'").withColumn("text", text)
    exclusive = F.array_compact(F.array(keyword_label(F.col("text"), V.STATE_EXCLUSIVE)))
    return K.multi_label_counts(rows, F.concat(exclusive, keyword_labels(F.col("text"), V.STATE_LABELS)))


@query(
    f"SELECT id FROM {_STATEMENTS} WHERE form = 1 OR (form = 0 AND false)"
)
def attribute_filter(spark, folder):
    from newsloom.operators.events import attribute_filter as keep

    rows = statements(spark, folder)
    return rows.where(keep("hit", F.col("badge"), F.col("target"), F.col("tags"))).select("id")


@query(
    f"SELECT round(avg(CASE WHEN category = 'signup' THEN 1 ELSE 0 END), 4) AS other, round(avg(CASE WHEN category = 'purchase' AND {_FORM} = 3 THEN 1 ELSE 0 END), 4) AS empty_weapon FROM {EV}"
)
def quality_rates(spark, folder):
    rows = items(spark, folder)
    return K.quality_rates(
        rows, other=F.col("category") == X.OTHER,
        empty_weapon=(F.col("category") == "bayanat") & (F.coalesce("weapon", F.lit("")) == ""),
    )


# -- whole pages and months ---------------------------------------------------------------


@query(
    f"SELECT date, count(*) FILTER (WHERE category = 'purchase') AS statements, count(*) FILTER (WHERE category = 'purchase' AND {_FORM} = 1) AS hits, "
    f"count(*) FILTER (WHERE category = 'purchase' AND {_FORM} = 1) AS tanks, CAST(0 AS BIGINT) AS aircraft, count(*) FILTER (WHERE category = 'purchase' AND {_FORM} = 2) AS settlements, "
    f"CAST(0 AS BIGINT) AS bases, count(*) FILTER (WHERE category = 'error') AS alerts FROM {EV} WHERE category <> 'signup' GROUP BY date"
)
def day_headlines(spark, folder):
    from newsloom.plans.pages import day_headlines as headlines

    return headlines(archive_events(spark, folder))


@query(
    f"SELECT 'classes' AS panel, CASE form WHEN 1 THEN 'tank' WHEN 2 THEN 'settlement' ELSE 'troops' END AS label, count(*) AS n FROM {_STATEMENTS} GROUP BY 2 "
    f"UNION ALL (SELECT 'places', regexp_extract(target, 'نقطة[12]', 0) AS label, count(*) AS n FROM {_STATEMENTS} WHERE regexp_matches(target, 'نقطة[12]') GROUP BY 2) "
    f"UNION ALL SELECT 'hits', 'hits', count(*) FILTER (WHERE form = 1) FROM {_STATEMENTS}"
)
def statement_page(spark, folder):
    from newsloom.plans.pages import statement_page as page

    sets = page(archive_events(spark, folder), ["نقطة1", "نقطة2"])
    hits = sets["hits"].select(F.lit("hits").alias("panel"), F.lit("hits").alias("label"), F.col("hits").alias("n"))
    named = [sets[p].select(F.lit(p).alias("panel"), "label", "n") for p in ("classes", "places")]
    return named[0].unionByName(named[1]).unionByName(hits)


_MONTHLY = (
    f"(SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) FILTER (WHERE category = 'purchase') AS bayanat, count(*) FILTER (WHERE category = 'error') AS sirens, "
    f"count(*) FILTER (WHERE category = 'view') AS enemy, count(*) FILTER (WHERE category = 'click') AS videos, count(DISTINCT date) AS days FROM {EV} WHERE category <> 'signup' GROUP BY 1)"
)


@query(
    f"WITH t AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, target, count(*) AS n FROM {_STATEMENTS} GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY n DESC, target) AS k FROM t), "
    "j AS (SELECT month, string_agg(target, ' و' ORDER BY k) AS targets FROM r WHERE k <= 3 GROUP BY month), "
    f"w AS (SELECT month, weapon FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, weapon, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY count(*) DESC, weapon) AS k FROM {_STATEMENTS} WHERE weapon <> '' GROUP BY 1, date_trunc('month', date), 2) WHERE k = 1), "
    f"p AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, max(n) AS peak FROM (SELECT date, count(*) AS n FROM {EV} WHERE category = 'error' GROUP BY date) GROUP BY 1) "
    "SELECT m.month, bayanat + sirens + enemy + videos AS total, days, peak, "
    "'ركّزت المقاومة عملياتها على ' || targets || '،' || ' باستخدام ' || weapon || ' بشكل رئيسي.' || "
    "CASE WHEN peak >= 15 THEN ' صفارات الإنذار لم تتوقف في مستوطنات الشمال، وبلغت ذروتها بـ' || peak || ' صفارة في يوم واحد.' ELSE ' صفارات الإنذار دوّت في مستوطنات الشمال بشكل متواصل.' END || "
    f"' إعلام العدو رصد تداعيات العمليات على مدى الشهر.' AS brief FROM {_MONTHLY} m JOIN j USING (month) JOIN w USING (month) JOIN p USING (month)"
)
def month_summary(spark, folder):
    from newsloom.plans.months import month_summary as summary

    rows = archive_events(spark, folder)
    months, _ = summary(K.daily_pivot(rows), rows)
    return months.select("month", "total", "days", "peak", "brief")


@query(
    f"WITH d AS (SELECT date, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS total, count(*) FILTER (WHERE category = 'error') AS sirens FROM {EV} WHERE category <> 'signup' GROUP BY date), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY total DESC, date) AS k FROM d), "
    f"f AS (SELECT date, target, min(id) AS first_id FROM {_STATEMENTS} GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY first_id) AS k FROM f), "
    "h AS (SELECT date, string_agg(target, ' و' ORDER BY k) AS targets FROM g WHERE k <= 3 GROUP BY date) "
    "SELECT t.date, total, CAST(row_number() OVER (PARTITION BY month ORDER BY t.date) AS INTEGER) AS number, 'استهداف ' || targets AS headline FROM t JOIN h ON t.date = h.date WHERE k <= 4"
)
def month_top_days(spark, folder):
    from newsloom.plans.months import month_summary as summary

    rows = archive_events(spark, folder)
    return summary(K.daily_pivot(rows), rows)[1].select("date", "total", "number", "headline")


@query(
    f"SELECT 'kpis' AS part, category AS key, count(*) AS n FROM {EV} GROUP BY 2 UNION ALL SELECT 'hours', substr(time, 1, 2), count(*) FROM {EV} GROUP BY 2 "
    f"UNION ALL SELECT 'days', CAST(date AS VARCHAR), n FROM (SELECT date, count(*) AS n FROM {EV} GROUP BY date ORDER BY n DESC, date LIMIT 20)"
)
def export_tables(spark, folder):
    from newsloom.plans.dashboard import export_tables as export

    sets = export(events(spark, folder).withColumns({c: F.lit(None).cast("string") for c in ("subtitle", "location", "full_text")}))
    return (
        sets["kpis"].select(F.lit("kpis").alias("part"), F.col("category").alias("key"), "n")
        .unionByName(sets["hourly_density"].select(F.lit("hours").alias("part"), F.lpad(F.col("hour").cast("string"), 2, "0").alias("key"), F.col("count").alias("n")))
        .unionByName(sets["most_active_days"].select(F.lit("days").alias("part"), F.col("date").cast("string").alias("key"), F.col("total").alias("n")))
    )


@query(f"SELECT date, count(*) FILTER (WHERE category = 'error') AS sirens, count(*) FILTER (WHERE category <> 'signup') AS total FROM {EV} GROUP BY date")
def day_index(spark, folder):
    rows = archive_events(spark, folder)
    index = P.day_index(K.daily_pivot(rows), P.keyword_rows(rows))
    return index.where("part = 0").select("date", "sirens", "total")
