"""Sequence, coverage, validation and comparison queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.operators import counts as K
from newsloom.operators import sequence as S
from newsloom.operators.scale import PART_SIZE, collect_parts, id_bucket, number_rows
from newsloom.operators.sets import missing_days as day_differences
from newsloom.plans import quality as Q
from newsloom.queries.archive import documents
from newsloom.queries.base import EV, events, query, table
from newsloom.schemas import REPORT
from newsloom.session import stage_table, work_dir
from newsloom.sinks.reports import publish_days, write_run
from newsloom.sources.reports import read_manifest, read_published

_DAILY = f"(SELECT date, count(*) AS n FROM {EV} WHERE category = 'error' AND dayofmonth(date) NOT IN (5, 17) AND (dayofmonth(date) % 6 > 0 OR hour(ts) < 6) GROUP BY date)"


def _daily(spark, folder):
    day = F.dayofmonth("date")
    rows = events(spark, folder).where((F.col("category") == "error") & ~day.isin(5, 17) & ((day % 6 > 0) | (F.hour("ts") < 6)))
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH m AS (SELECT date, n, avg(n) OVER (PARTITION BY date_trunc('month', date)) AS a FROM {_DAILY}) SELECT date, n, n < 0.5 * a AS suspect, CASE WHEN n < 0.5 * a THEN CASE WHEN n > 15 THEN 'high' ELSE 'low' END END AS confidence FROM m")
def below_period_mean(spark, folder):
    return S.below_period_mean(_daily(spark, folder), high=F.col("n") > 15).select("date", "n", "suspect", "confidence")


@query(f"SELECT date, n, median, coalesce(n < 0.5 * median, false) AS repull FROM (SELECT date, n, quantile_cont(n, 0.5) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS median FROM {_DAILY})")
def trailing_median(spark, folder):
    return S.trailing_median(_daily(spark, folder))


_COVER = (
    f"(WITH r AS {_DAILY}, i AS (SELECT date, count(*) AS items FROM {EV} WHERE category = 'view' GROUP BY date), "
    "b AS (SELECT min(date) AS a, max(date) AS b FROM (SELECT date FROM r UNION SELECT date FROM i)), "
    "c AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM b), "
    "j AS (SELECT c.date, coalesce(r.n, 0) AS raw, coalesce(i.items, 0) AS items, avg(r.n) OVER (PARTITION BY date_trunc('month', c.date)) AS month_avg FROM c LEFT JOIN r ON c.date = r.date LEFT JOIN i ON c.date = i.date) "
    "SELECT *, raw > 0 AS covered, raw > 0 AND raw < 0.5 * month_avg AS suspect FROM j)"
)


def _coverage(spark, folder):
    items = events(spark, folder).where("category = 'view'").groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return Q.coverage_days(_daily(spark, folder), items)


@query(f"SELECT date, raw, round(month_avg, 4) AS month_avg, items, covered, suspect FROM {_COVER}")
def coverage_join(spark, folder):
    return _coverage(spark, folder).select("date", "raw", F.round("month_avg", 4).alias("month_avg"), "items", "covered", "suspect")


@query(
    f"SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS days, count(*) FILTER (WHERE covered) AS covered, count(*) FILTER (WHERE NOT covered) AS no_raw, "
    f"count(*) FILTER (WHERE suspect) AS suspects, quantile_cont(CASE WHEN covered THEN raw END, 0.5) AS median, CAST(sum(items) AS BIGINT) AS items, "
    f"CAST(printf('%.1f', avg(raw) FILTER (WHERE covered)) AS DOUBLE) AS avg, "
    f"CAST(printf('%.1f', least(100.0, greatest(0.0, 100 * ((count(*) FILTER (WHERE covered) - 0.5::DOUBLE * count(*) FILTER (WHERE suspect)) / count(*)))::DOUBLE)) AS DOUBLE) AS score FROM {_COVER} GROUP BY 1"
)
def month_coverage(spark, folder):
    return Q.month_coverage(_coverage(spark, folder))


@query(f"SELECT CAST(round(sum(CASE WHEN NOT covered THEN greatest(month_avg - raw, 0) ELSE 0 END)) AS BIGINT) AS uncovered, CAST(round(sum(CASE WHEN suspect THEN greatest(month_avg - raw, 0) ELSE 0 END)) AS BIGINT) AS suspect FROM {_COVER}")
def missing_estimate(spark, folder):
    return Q.missing_estimate(_coverage(spark, folder))


@query(
    f"WITH a AS (SELECT date_trunc('month', date) AS m, CAST(floor(avg(n)) AS BIGINT) AS a FROM {_DAILY} GROUP BY 1) "
    f"SELECT date, n AS records, CAST(greatest(5, a // 2) AS INTEGER) AS threshold, n >= greatest(5, a // 2) AS adequate FROM {_DAILY} JOIN a ON date_trunc('month', date) = m"
)
def pull_audit(spark, folder):
    days = _daily(spark, folder)
    averages = days.groupBy(F.trunc("date", "MM").alias("month")).agg(F.floor(F.avg("n")).alias("average"))
    return Q.pull_audit(days.withColumnRenamed("n", "records"), averages)


@query("SELECT conv_id, turn, count(*) AS n FROM conversations GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT l_orderkey, l_linenumber, count(*) FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("conv_id"), F.col("l_linenumber").cast("long").alias("turn"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn")
    return K.duplicates(turns, ["conv_id"], "turn").unionByName(K.duplicates(lines, ["conv_id"], "turn"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, folder):
    """Grouped on a hash of the text; the texts of a group are compared, too."""
    hashed = table(spark, folder, "documents").select(F.xxhash64("text").alias("h"), "text")
    return K.duplicates(hashed, ["h"], "text").select("text", "n")


@query(
    "WITH m AS (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1), g AS (SELECT l_orderkey, CAST(unnest(range(1, top)) AS INTEGER) AS missing FROM m) "
    "SELECT l_orderkey, missing FROM g WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = g.l_orderkey AND l.l_linenumber = g.missing)"
)
def sequence_gaps(spark, folder):
    gaps = S.sequence_gaps(table(spark, folder, "lineitem"), ["l_orderkey"], "l_linenumber", width=2)
    return gaps.select("l_orderkey", F.col("missing").cast("int").alias("missing"))


@query(
    f"WITH p AS (SELECT DISTINCT date, user_id AS num FROM {EV} WHERE category = 'click' AND user_id > 0), m AS (SELECT date, max(num) AS top FROM p GROUP BY date), "
    "g AS (SELECT date, unnest(range(1, top)) AS missing FROM m) SELECT g.date, g.missing FROM g LEFT JOIN p ON p.date = g.date AND p.num = g.missing WHERE p.num IS NULL"
)
def sequence_gaps_by_day(spark, folder):
    return S.sequence_gaps(events(spark, folder).where("category = 'click'"), ["date"], "user_id", width=16)


# Numbered statements: numbers follow the order of a day; on every third day
# they start again late in the evening, on every fourth the first of a day goes
# on from the day before.
_NUM = (
    f"(WITH e AS (SELECT id, date, time, row_number() OVER (PARTITION BY date ORDER BY id) - 1 AS position, count(*) OVER (PARTITION BY date) AS n FROM {EV} WHERE category = 'purchase'), "
    "l AS (SELECT *, min(CASE WHEN time >= '22:30' THEN position END) OVER (PARTITION BY date) AS cut FROM e), "
    "d AS (SELECT date, count(*) AS pn FROM e GROUP BY date) "
    "SELECT l.id, l.date, l.time, l.position, CAST(CASE WHEN dayofmonth(l.date) % 4 = 0 AND l.position = 0 THEN coalesce(d.pn, 0) + 1 "
    "WHEN dayofmonth(l.date) % 3 = 0 AND time >= '22:30' THEN l.position - cut + 1 ELSE l.position + 1 END AS INTEGER) AS num, "
    "CASE WHEN l.position % 11 = 5 THEN 'communique' ELSE '' END AS badge "
    "FROM l LEFT JOIN d ON d.date = l.date - 1)"
)


def _numbered(spark, folder):
    rows = events(spark, folder).where("category = 'purchase'").select("id", "date", "time")
    placed = number_rows(rows, ["date"], ["id"], [F.floor(F.col("id") / 64)], "position")
    days = placed.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("time") >= "22:30", F.col("position"))).alias("cut"))
    before = days.select(F.date_add("date", 1).alias("date"), F.col("n").alias("pn"))
    joined = placed.join(days.drop("n"), "date").join(before, "date", "left")
    day, pos = F.dayofmonth("date"), F.col("position")
    num = (
        F.when((day % 4 == 0) & (pos == 0), F.coalesce("pn", F.lit(0)) + 1)
        .when((day % 3 == 0) & (F.col("time") >= "22:30"), pos - F.col("cut") + 1).otherwise(pos + 1)
    )
    return joined.select("id", "date", "time", "position", num.cast("int").alias("num"), F.when(pos % 11 == 5, "communique").otherwise("").alias("badge"))


_MOVED = (
    f"(WITH s AS {_NUM}, e AS (SELECT *, CASE WHEN badge <> 'communique' AND num > 0 THEN num END AS k FROM s), "
    "p AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY date ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e), "
    "r AS (SELECT date, max(CASE WHEN prev - k >= 5 THEN position END) AS restart FROM p GROUP BY date), "
    "v AS (SELECT p.date, r.restart, bool_and(p.time >= '21:00' OR p.num <= 0) AS late FROM p JOIN r ON p.date = r.date AND p.position >= r.restart GROUP BY 1, 2) "
    "SELECT s.*, coalesce(v.late AND s.position >= v.restart, false) AS moved FROM s LEFT JOIN v ON s.date = v.date)"
)


@query(f"SELECT id, date, num, moved, CAST(CASE WHEN moved THEN date + 1 ELSE date END AS DATE) AS new_date FROM {_MOVED}")
def sequence_restart(spark, folder):
    return S.sequence_restart(_numbered(spark, folder), width=16).select("id", "date", "num", "moved", "new_date")


@query(
    f"WITH s AS {_NUM}, f AS (SELECT date, arg_min(id, position) AS id, arg_min(num, position) AS num, arg_min(time, position) AS time FROM s GROUP BY date), "
    "l AS (SELECT date, arg_max(num, position) AS last FROM s GROUP BY date), "
    "b AS (SELECT f.id FROM f JOIN l ON l.date = f.date - 1 WHERE f.time < '02:00' AND f.num > 3 AND f.num - l.last IN (1, 2)) "
    "SELECT s.id, s.date, CAST(CASE WHEN b.id IS NOT NULL THEN s.date - 1 ELSE s.date END AS DATE) AS new_date FROM s LEFT JOIN b ON s.id = b.id"
)
def sequence_carry_back(spark, folder):
    return S.sequence_carry_back(_numbered(spark, folder)).select("id", "date", "new_date")


@query(
    "SELECT o_orderkey, counter, coalesce(n, 0) AS n FROM (SELECT o_orderkey, o_orderkey % 7 AS counter FROM orders) LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE counter <> coalesce(n, 0)"
)
def counter_check(spark, folder):
    stored = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("counter"))
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return Q.counter_check(stored, lines, ["o_orderkey"])


@query(
    "WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) "
    "SELECT date, 'not in index' AS side FROM a WHERE date NOT IN (SELECT date FROM b) UNION ALL SELECT date, 'no data' FROM b WHERE date NOT IN (SELECT date FROM a)"
)
def missing_days(spark, folder):
    ordered = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("date"))
    shipped = table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return day_differences(ordered, shipped)


@query(
    "WITH a AS (SELECT p_type AS bucket, count(*) AS n FROM part WHERE p_size % 3 > 0 GROUP BY 1), b AS (SELECT p_type AS bucket, count(*) AS n FROM part WHERE p_size > 10 OR p_type = 'PROMO' GROUP BY 1) "
    "SELECT bucket, b.n AS published, a.n AS ours, CASE WHEN b.n > 0 THEN CAST(round(100.0 * coalesce(a.n, 0) / b.n) AS BIGINT) END AS coverage, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM a FULL JOIN b USING (bucket)"
)
def compare_to_published(spark, folder):
    part = table(spark, folder, "part")

    def counted(condition):
        return part.where(condition).groupBy(F.col("p_type").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))

    return Q.compare_to_published(counted("p_size % 3 > 0"), counted("p_size > 10 OR p_type = 'PROMO'"))


def _spoiled(spark, folder, part_size=PART_SIZE):
    """Day documents of the event archive with planted faults."""
    day = F.dayofmonth(F.to_date("date"))
    docs = documents(spark, folder, part_size).withColumn("file_date", F.col("date")).withColumn("_corrupt_record", F.lit(None).cast("string"))
    stats = F.col("stats").withField("videos", F.when(day % 5 == 0, F.col("stats.videos") + 1).when(day % 5 == 1, F.lit(None)).otherwise(F.col("stats.videos")))
    return (
        docs.withColumn("stats", stats)
        .withColumn("dayAr", F.when(day % 6 == 0, F.lit("يوم")).otherwise(F.col("dayAr")))
        .withColumn("enemy", F.when(day % 7 == 0, F.transform("enemy", lambda e: e.withField("summary", F.lit("")).withField("fullText", F.lit("")))).otherwise(F.col("enemy")))
    )


_DAYS = f"(SELECT date, dayofmonth(date) AS d, count(*) FILTER (WHERE category = 'view') AS views FROM {EV} WHERE category <> 'signup' GROUP BY date)"
_NUMBERS = f"(SELECT date, user_id FROM {EV} WHERE category = 'purchase' AND user_id % 4 <> 3 AND user_id <> 0)"
_ISSUES = (
    f"(SELECT date, 'stats' AS category, 'error' AS severity, CAST(1 AS BIGINT) AS n FROM {_DAYS} WHERE d % 5 = 0 UNION ALL SELECT date, 'stats', 'warn', 1 FROM {_DAYS} WHERE d % 5 = 1 "
    f"UNION ALL SELECT date, 'dayAr', 'warn', 1 FROM {_DAYS} WHERE d % 6 = 0 UNION ALL SELECT date, 'enemy_field', 'warn', views FROM {_DAYS} WHERE d % 7 = 0 AND views > 0 "
    f"UNION ALL SELECT date, 'siren_points', 'warn', 1 FROM {_DAYS} WHERE date IN (SELECT date FROM {EV} WHERE category = 'error') "
    f"UNION ALL SELECT date, 'bayan_num', 'error', 1 FROM {_NUMBERS} GROUP BY date HAVING count(*) > count(DISTINCT user_id) "
    f"UNION ALL SELECT date, 'bayan_num', 'warn', 1 FROM {_NUMBERS} GROUP BY date HAVING max(user_id) > count(DISTINCT user_id))"
)


def _issues(spark, folder, part_size=PART_SIZE):
    """Documents are staged: rules over rows and over numbers both read them."""
    return Q.report_issues(stage_table(_spoiled(spark, folder, part_size), "spoiled"))


_BY_DAY = f"SELECT CAST(date AS VARCHAR) AS date, category, severity, CAST(sum(n) AS BIGINT) AS n FROM {_ISSUES} GROUP BY ALL"


@query(_BY_DAY)
def validate_issues(spark, folder):
    return _issues(spark, folder).groupBy("date", "category", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(_BY_DAY)
def validate_issues_parts(spark, folder):
    """From days split into documents of five items."""
    return _issues(spark, folder, 5).groupBy("date", "category", "severity").agg(F.count(F.lit(1)).alias("n"))


_DAY_NAMES = "['الإثنين', 'الثلاثاء', 'الأربعاء', 'الخميس', 'الجمعة', 'السبت', 'الأحد']"


def _listed(numbers: str, size: int) -> str:
    """Messages on the numbers of a table ``date, num``, ``size`` numbers a row."""
    return (
        f"(WITH p AS (SELECT date, num, count(*) AS n FROM {numbers} GROUP BY ALL), m AS (SELECT date, max(num) AS top FROM p GROUP BY date), "
        "k AS (SELECT date, 'error' AS severity, 'Duplicate bayan numbers: ' AS start, num FROM p WHERE n > 1 "
        "UNION ALL SELECT date, 'warn', 'Extra bayan numbers outside expected range: ', num FROM p WHERE num < 1 "
        "UNION ALL SELECT g.date, 'warn', 'Missing bayan numbers in sequence: ', g.num FROM (SELECT date, unnest(range(1, top)) AS num FROM m) g ANTI JOIN p USING (date, num)), "
        f"r AS (SELECT *, (row_number() OVER (PARTITION BY date, start ORDER BY num) - 1) // {size} AS part FROM k) "
        "SELECT CAST(date AS VARCHAR) AS date, 'bayan_num' AS category, severity, start || '[' || string_agg(num, ', ' ORDER BY num) || ']' AS message FROM r GROUP BY date, severity, start, part)"
    )


_MESSAGES = (
    "WITH d AS (SELECT CAST(date AS VARCHAR) AS date, dayofmonth(date) AS d, isodow(date) AS w, count(*) FILTER (WHERE category = 'view') AS views, count(*) FILTER (WHERE category = 'click') AS clicks, "
    f"count(*) FILTER (WHERE category = 'error') AS alerts FROM {EV} AS e WHERE category <> 'signup' GROUP BY ALL) "
    "SELECT date, 'stats' AS category, 'error' AS severity, 'stats.videos=' || (clicks + 1) || ' but actual array length=' || clicks AS message FROM d WHERE d % 5 = 0 "
    "UNION ALL SELECT date, 'stats', 'warn', 'Missing stats.videos (actual: ' || clicks || ')' FROM d WHERE d % 5 = 1 "
    f"UNION ALL SELECT date, 'dayAr', 'warn', 'dayAr ''يوم'' should be ''' || {_DAY_NAMES}[w] || '''' FROM d WHERE d % 6 = 0 "
    "UNION ALL SELECT date, 'enemy_field', 'warn', 'Enemy[' || i || '] missing summary and fullText' FROM (SELECT date, unnest(range(views)) AS i FROM d WHERE d % 7 = 0) "
    "UNION ALL SELECT date, 'siren_points', 'warn', 'Has ' || alerts || ' sirens but no sirenPoints (0 geocodable from known locations)' FROM d WHERE alerts > 0 "
    f"UNION ALL SELECT * FROM {_listed(f'(SELECT date, user_id AS num FROM {_NUMBERS})', 10_000)}"
)


@query(_MESSAGES)
def validate_messages(spark, folder):
    """The issues themselves, row by row."""
    return _issues(spark, folder)


@query(_MESSAGES)
def validate_messages_parts(spark, folder):
    """The same from documents of five items: positions and counts are the day's."""
    return _issues(spark, folder, 5)


_OFFSET_NUMBERS = f"(SELECT date, user_id - 50 AS num FROM {EV} WHERE category = 'click' AND user_id <> 50)"


@query(f"SELECT * FROM {_listed(_OFFSET_NUMBERS, 40)}")
def number_listings(spark, folder):
    """Repeated, missing and outside numbers of days in several documents, listed
    40 at a time."""
    rows = events(spark, folder).where("category = 'click'").select(
        F.col("date").cast("string").alias("file_date"), (F.col("id") % 7).alias("part"), (F.col("user_id") - 50).cast("int").alias("num"))
    docs = rows.groupBy("file_date", "part").agg(F.collect_list(F.struct(F.lit("").alias("badge"), "num")).alias("bayanat"))
    return Q.number_issues(docs, part_size=40, width=16)


@query(f"SELECT category, severity, CAST(sum(n) AS BIGINT) AS n FROM {_ISSUES} GROUP BY 1, 2")
def issue_counts(spark, folder):
    return Q.issue_counts(_issues(spark, folder))


@query(
    f"WITH t AS (SELECT category, CAST(sum(n) AS BIGINT) AS total FROM {_ISSUES} GROUP BY 1) SELECT category, least(total, 50) AS n FROM t"
)
def issue_report(spark, folder):
    """The printed report: at most 50 issues of a category."""
    return Q.issue_report(_issues(spark, folder), 50)["first"].groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH b AS (SELECT DISTINCT date FROM {_ISSUES}), a AS (SELECT count(*) AS days, count(b.date) AS bad FROM {_DAYS} d LEFT JOIN b ON d.date = b.date) "
    "SELECT days, bad AS days_with_issues, days - bad AS clean, CAST(printf('%.1f', 100.0 * (days - bad) / days) AS DOUBLE) AS clean_percent FROM a"
)
def clean_days(spark, folder):
    docs = stage_table(_spoiled(spark, folder), "spoiled")
    return Q.clean_days(Q.report_issues(docs), docs.select("date"))


@query(f"SELECT date, count(*) FILTER (WHERE category = 'click') AS videos, {'['}{', '.join(repr(n) for n in ('الإثنين', 'الثلاثاء', 'الأربعاء', 'الخميس', 'الجمعة', 'السبت', 'الأحد'))}{']'}[isodow(date)] AS day_name FROM {EV} WHERE category <> 'signup' GROUP BY date")
def repair_documents(spark, folder):
    fixed = Q.repair_documents(_spoiled(spark, folder))
    return fixed.select(F.to_date("date").alias("date"), F.col("stats.videos").cast("long").alias("videos"), F.col("dayAr").alias("day_name"))


_REPAIRED = f"(SELECT CAST(CASE WHEN moved THEN date + 1 ELSE date END AS DATE) AS date, num, time, moved, position FROM {_MOVED})"


_REPAIRED_DAYS = (
    f"WITH r AS {_REPAIRED}, o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY moved DESC, position) AS k, count(*) OVER (PARTITION BY date) AS n FROM r), "
    "l AS (SELECT date, arg_max(num, k) AS last FROM o GROUP BY date), "
    "b AS (SELECT o.date, o.k FROM o JOIN l ON l.date = o.date - 1 WHERE o.k = 1 AND o.time < '02:00' AND o.num > 3 AND o.num - l.last IN (1, 2)), "
    "f AS (SELECT CAST(CASE WHEN b.k IS NOT NULL THEN o.date - 1 ELSE o.date END AS DATE) AS date, o.num FROM o LEFT JOIN b ON o.date = b.date AND o.k = b.k) "
    "SELECT date, CAST(count(*) AS INTEGER) AS statements, CAST(sum(num) AS BIGINT) AS numbers FROM f GROUP BY date"
)


@query(_REPAIRED_DAYS)
def repair_archive(spark, folder):
    """Numbered statements as day documents, repaired as a whole."""
    return _repaired_days(spark, folder, PART_SIZE)


@query(_REPAIRED_DAYS)
def repair_archive_parts(spark, folder):
    """From days split into documents of five statements."""
    return _repaired_days(spark, folder, 5)


_SOURCED = f"(SELECT date AS src, CAST(CASE WHEN moved THEN date + 1 ELSE date END AS DATE) AS date, num, time, moved, position FROM {_MOVED})"


@query(
    _REPAIRED_DAYS.replace(_REPAIRED, _SOURCED).replace("AS date, o.num FROM o", "AS date, o.num, o.src FROM o").replace(
        "SELECT date, CAST(count(*)", "SELECT date, date IN (SELECT src FROM f WHERE src <> date UNION ALL SELECT date FROM f WHERE src <> date) AS rewritten, CAST(count(*)")
)
def repair_published(spark, folder):
    """A published archive repaired: only days with changes are written anew and
    swapped in; the remains of a run that was never published are not read."""
    root = f"{work_dir(spark)}/published-{uuid.uuid4().hex}"
    docs = Q.repair_documents(_statement_documents(spark, folder, 5))
    publish_days(docs.drop("file_date"), root)
    before = read_published(spark, root)
    first = read_manifest(spark, root)[1].first()["run"]
    write_run(before.drop("file_date", "run", "_corrupt_record").withColumn("bayanat", F.slice("bayanat", 1, 1)), root)
    publish_days(Q.repair_changed(before, part_size=5)[0], root)
    after = read_published(spark, root).where(F.size("bayanat") > 0)
    return _day_sums(after, F.max(F.col("run") != first).alias("rewritten"))


def _repaired_days(spark, folder, part_size):
    docs = _statement_documents(spark, folder, part_size)
    return _day_sums(Q.repair_archive(docs, part_size=part_size).where(F.size("bayanat") > 0))


def _statement_documents(spark, folder, part_size):
    item = F.struct(
        "num", F.col("time").alias("postTime"), *[F.lit("").alias(n) for n in ("opTime", "target", "weapon")], "badge",
        F.array().cast("array<string>").alias("tags"), *[F.lit("x").alias(n) for n in ("bayan_type", "fullText")],
        F.lit(None).cast(REPORT["bayanat"].dataType.elementType["strikes"].dataType).alias("strikes"),
    )
    numbered = stage_table(_numbered(spark, folder), "numbered")
    lists = collect_parts(numbered, ["date"], ["position"], [id_bucket("position")], item, "bayanat", part_size)
    return lists.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.date_format("date", "yyyy-MM-dd").alias("file_date"), "bayanat", "part",
        (F.col("part").cast("long") * part_size).alias("first_position"),
        *[F.lit(None).cast(REPORT[c].dataType).alias(c) for c in REPORT.fieldNames() if c not in ("date", "bayanat")],
    )


def _day_sums(docs, *more):
    numbers = F.aggregate("bayanat", F.lit(0).cast("long"), lambda acc, b: acc + b["num"])
    return docs.groupBy(F.to_date("date").alias("date")).agg(F.max("stats.bayanat").alias("statements"), F.sum(numbers).alias("numbers"), *more)

