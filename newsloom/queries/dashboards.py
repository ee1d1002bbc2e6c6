"""Dashboard, paging, month and day queries."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.geo import percent, round_exact
from newsloom.functions import dates as D
from newsloom.functions.geo import intensity_bucket
from newsloom.operators import counts as K
from newsloom.operators import events as E
from newsloom.operators import sequence as S
from newsloom.plans import months as M
from newsloom.plans.dashboard import dashboard
from newsloom.queries.base import EV, KINDS, REPORTS, daily_reports, events, query, sum_case, table
from newsloom.session import work_dir
from newsloom.sinks.reports import write_event_tables
from newsloom.sources import reports as R

JAN10, JAN20 = dt.date(2024, 1, 10), dt.date(2024, 1, 20)


@query(f"SELECT category, count(*) AS n FROM {EV} GROUP BY category")
def kpi_counts(spark, folder):
    return K.kpi_counts(events(spark, folder), KINDS).select("category", "n")


@query(
    f"SELECT category, count(*) AS n FROM {EV} WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' "
    "AND category IN ('click', 'view') GROUP BY category"
)
def filter_events(spark, folder):
    return K.kpi_ranked(E.filter_events(events(spark, folder), JAN10, JAN20, ["click", "view"], KINDS))


@query(f"SELECT * FROM {REPORTS}")
def daily_pivot(spark, folder):
    return daily_reports(spark, folder)


def _series_sql(fmt: str) -> str:
    return f"SELECT strftime(date, '{fmt}') AS period, {sum_case('category', KINDS)} FROM {EV} GROUP BY 1"


@query(_series_sql("%Y-%m-%d"))
def series_daily(spark, folder):
    return K.time_series(events(spark, folder), "daily", KINDS)


@query(_series_sql("%Y-W%W"))
def series_weekly(spark, folder):
    return K.time_series(events(spark, folder), "weekly", KINDS)


@query(_series_sql("%Y-%m"))
def series_monthly(spark, folder):
    return K.time_series(events(spark, folder), "monthly", KINDS)


@query(
    "SELECT strftime(o_orderdate, '%Y-W%W') AS period, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS F, "
    "CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS O, "
    "CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS P FROM orders GROUP BY 1"
)
def series_weekly_orders(spark, folder):
    orders = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("category"))
    return K.time_series(orders, "weekly", ("F", "O", "P"))


@query(f"SELECT CAST(substr(time, 1, 2) AS INTEGER) AS hour, CAST(dayofweek(date) AS INTEGER) AS dow, count(*) AS count FROM {EV} WHERE length(time) >= 5 GROUP BY 1, 2")
def hour_dow_heatmap(spark, folder):
    return K.hour_dow_heatmap(events(spark, folder))


@query(
    f"WITH c AS (SELECT CAST(substr(time, 1, 2) AS INTEGER) AS hour, CAST(dayofweek(date) AS INTEGER) AS dow, count(*) AS count FROM {EV} GROUP BY 1, 2), "
    "d AS (SELECT dow, CAST(sum(count) AS BIGINT) AS day_total FROM c GROUP BY dow), h AS (SELECT hour, CAST(sum(count) AS BIGINT) AS hour_total FROM c GROUP BY hour), "
    "g AS (SELECT CAST(sum(count) AS BIGINT) AS grand_total, max(count) AS peak FROM c) "
    "SELECT hour, dow, count, day_total, hour_total, grand_total, peak, CAST(round(100.0 * count / peak) AS BIGINT) AS share_of_peak, "
    "CASE WHEN s * 4 = floor(s * 4) AND CAST(floor(s * 20) AS BIGINT) % 2 = 1 AND s * 20 = floor(s * 20) THEN (floor(s * 10) + 1) / 10 ELSE CAST(printf('%.1f', s) AS DOUBLE) END AS share "
    "FROM (SELECT *, CAST(count AS DOUBLE) / grand_total * 100.0 AS s FROM c JOIN d USING (dow) JOIN h USING (hour), g)"
)
def heatmap_margins(spark, folder):
    return K.heatmap_margins(events(spark, folder))


#: n / 20 to one decimal, n from 0: the two rules of rounding, as literals.
_EVEN = (0.0, 0.1, 0.1, 0.1, 0.2, 0.2, 0.3, 0.3, 0.4, 0.5, 0.5, 0.6, 0.6, 0.7, 0.7, 0.8, 0.8, 0.8, 0.9, 0.9)
_PAGES = (0.0, 0.1, 0.1, 0.1, 0.2, 0.3, 0.3, 0.3, 0.4, 0.5, 0.5, 0.6, 0.6, 0.7, 0.7, 0.8, 0.8, 0.8, 0.9, 0.9)


@query(f"SELECT p_partkey, {list(_EVEN)}[p_partkey % 20 + 1]::DOUBLE AS even, {list(_PAGES)}[p_partkey % 20 + 1]::DOUBLE AS pages, 0.3::DOUBLE AS percent FROM part")
def exact_rounding(spark, folder):
    """Ties in decimals are mostly none in binary: 3/20 is below 0.15."""
    value = F.col("p_partkey") % 20 / F.lit(20.0)
    return table(spark, folder, "part").select(
        "p_partkey", round_exact(value).alias("even"), round_exact(value, 1, "up").alias("pages"), percent(F.lit(1), F.lit(400)).alias("percent"))


@query(f"SELECT h AS hour, CAST(coalesce(n, 0) AS BIGINT) AS count FROM (SELECT CAST(range AS INTEGER) AS h FROM range(24)) LEFT JOIN (SELECT CAST(substr(time, 1, 2) AS INTEGER) AS hh, count(*) AS n FROM {EV} WHERE category = 'error' GROUP BY 1) ON h = hh")
def hour_density(spark, folder):
    return K.hour_density(events(spark, folder).where("category = 'error'"), dense=True)


@query("SELECT p_name AS name, count(*) AS value FROM part WHERE p_name <> '' GROUP BY 1 ORDER BY value DESC, name LIMIT 10")
def top_values(spark, folder):
    return K.top_values(table(spark, folder, "part"), "p_name", 10)


@query(f"SELECT date, count(*) AS total FROM {EV} GROUP BY date ORDER BY total DESC, date LIMIT 20")
def most_active_days(spark, folder):
    return K.most_active_days(events(spark, folder), 20)


@query(f"SELECT * FROM {REPORTS} ORDER BY click DESC, date DESC LIMIT 10 OFFSET 10")
def table_page(spark, folder):
    return E.page(daily_reports(spark, folder), "click", True, 2, 10, ("date", *KINDS, "total"))


_STATE = f"(SELECT * FROM {EV} WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' AND category IN ('click', 'error', 'view'))"
_LONG = " UNION ALL ".join(
    f"SELECT '{panel}', {key}, '{c}', {c} FROM {panel}"
    for panel, key, names in (("series", "period", ("click", "error", "view")), ("days", "CAST(date AS VARCHAR)", ("click", "error", "purchase", "total")))
    for c in names
)


@query(
    f"WITH e AS {_STATE}, series AS (SELECT strftime(date, '%Y-W%W') AS period, {sum_case('category', KINDS)} FROM e GROUP BY 1), "
    f"days AS (SELECT date, {sum_case('category', KINDS)}, count(*) AS total FROM e GROUP BY 1 ORDER BY error DESC, date DESC LIMIT 5 OFFSET 5) "
    "SELECT 'kpis' AS panel, k AS a, NULL::VARCHAR AS b, coalesce(n, 0) AS n "
    f"FROM (SELECT unnest({list(KINDS)}) AS k) LEFT JOIN (SELECT category, count(*) AS n FROM e GROUP BY 1) ON k = category UNION ALL {_LONG} "
    "UNION ALL SELECT 'heatmap', CAST(CAST(substr(time, 1, 2) AS INTEGER) AS VARCHAR), CAST(dayofweek(date) AS VARCHAR), count(*) FROM e GROUP BY 2, 3 "
    "UNION ALL SELECT * FROM (SELECT 'top_values', title, NULL, count(*) AS n FROM e WHERE category = 'view' GROUP BY 2 ORDER BY n DESC, title LIMIT 10) "
    "UNION ALL SELECT 'pages', CAST(count(DISTINCT date) AS VARCHAR), NULL, CAST(ceil(count(DISTINCT date) / 5.0) AS BIGINT) FROM e"
)
def dashboard_panels(spark, folder):
    """All panels of one filter state, whole, as ``panel, a, b, n``: one scan of the events."""
    sets = dashboard(
        events(spark, folder), dt.date(2024, 1, 3), dt.date(2024, 1, 25), ["click", "error", "view"], "weekly", "error", True, 2, 5,
        KINDS, ("click", "error", "purchase"), "view")
    none = F.lit(None).cast("string")

    def long(panel, rows, key, names):
        entries = F.array(*[F.struct(F.lit(c).alias("b"), F.col(c).alias("n")) for c in names])
        return rows.select(F.lit(panel).alias("panel"), F.col(key).cast("string").alias("a"), F.inline(entries))

    parts = [
        sets["kpis"].select(F.lit("kpis").alias("panel"), F.col("category").alias("a"), none.alias("b"), "n"),
        long("series", sets["series"], "period", ("click", "error", "view")),
        long("days", sets["table"], "date", ("click", "error", "purchase", "total")),
        sets["heatmap"].select(F.lit("heatmap"), F.col("hour").cast("string"), F.col("dow").cast("string"), "count"),
        sets["top_values"].select(F.lit("top_values"), "name", none, "value"),
        sets["pages"].select(F.lit("pages"), F.col("days").cast("string"), none, "pages"),
    ]
    return reduce(DataFrame.union, parts)


@query(f"SELECT count(DISTINCT date) AS days, CAST(greatest(1, ceil(count(DISTINCT date) / 10.0)) AS BIGINT) AS pages FROM {EV}")
def page_count(spark, folder):
    return E.page_count(events(spark, folder))


@query("SELECT min(CAST(o_orderdate AS DATE)) AS min_date, max(CAST(o_orderdate AS DATE)) AS max_date FROM orders")
def date_extent(spark, folder):
    return K.date_extent(table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date")))


@query("SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def table_counts(spark, folder):
    return K.table_counts({n: table(spark, folder, n) for n in ("orders", "events", "documents")})


@query(
    f"SELECT id, date, category, time, title, total FROM {EV} JOIN (SELECT date, count(*) AS total FROM {EV} GROUP BY date) USING (date) "
    "WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'"
)
def event_tables_range(spark, folder):
    """Both event tables written and a range of days read back: only the folders
    of the range are listed and read."""
    path = f"{work_dir(spark)}/tables-{uuid.uuid4().hex}"
    write_event_tables(events(spark, folder), daily_reports(spark, folder), path)
    stored = [R.scan_date_range(spark.read.parquet(f"{path}/{name}"), JAN10, JAN20) for name in ("events", "reports")]
    return stored[0].join(stored[1].select("date", "total"), "date").select("id", "date", "category", "time", "title", "total")


@query(
    "SELECT greatest(DATE '1998-02-01', min(CAST(o_orderdate AS DATE))) AS range_start, "
    "least(DATE '1998-02-28', max(CAST(o_orderdate AS DATE))) AS range_end FROM orders"
)
def default_range(spark, folder):
    extent = K.date_extent(table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date")))
    start, end = D.default_range(F.lit(dt.date(1998, 2, 17)), F.col("min_date"), F.col("max_date"))
    return extent.select(start.alias("range_start"), end.alias("range_end"))


@query(f"SELECT id, date, category, row_number() OVER (PARTITION BY date, category ORDER BY id) - 1 AS src_idx FROM {EV}")
def source_index(spark, folder):
    return S.source_index(events(spark, folder).select("id", "date", "category"), width=64)


@query(
    f"SELECT id, CAST(rank AS INTEGER) AS rank, related_id FROM (SELECT a.id AS id, b.id AS related_id, row_number() OVER (PARTITION BY a.id ORDER BY b.time DESC, b.id) AS rank "
    f"FROM {EV} a JOIN {EV} b ON a.date = b.date AND a.id <> b.id) WHERE rank <= 3"
)
def related_events(spark, folder):
    return S.related_events(events(spark, folder).select("id", "date", "time"))


@query(
    f"SELECT date, lag(date) OVER (ORDER BY date) AS previous, lead(date) OVER (ORDER BY date) AS next, "
    f"CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS number, count(*) OVER () AS of FROM (SELECT DISTINCT date FROM {EV} WHERE category = 'error' AND dayofmonth(date) % 3 > 0)"
)
def prev_next_day(spark, folder):
    days = events(spark, folder).where((F.col("category") == "error") & (F.dayofmonth("date") % 3 > 0)).select("date").distinct()
    return S.prev_next(days)


STATUS = ("F", "O", "P")
_ORDER_DAYS = (
    "(SELECT CAST(o_orderdate AS DATE) AS date, " + sum_case("o_orderstatus", STATUS) + ", count(*) AS total FROM orders GROUP BY 1)"
)
_ORDER_MONTHS = (
    f"(SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(F) AS BIGINT) AS F, CAST(sum(O) AS BIGINT) AS O, "
    f"CAST(sum(P) AS BIGINT) AS P, count(DISTINCT date) AS days, CAST(sum(F) + sum(O) + sum(P) AS BIGINT) AS total FROM {_ORDER_DAYS} GROUP BY 1)"
)


def _order_days(spark, folder):
    rows = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("category"))
    return K.daily_pivot(rows, STATUS)


@query(f"SELECT * FROM {_ORDER_MONTHS}")
def month_totals(spark, folder):
    return K.month_totals(_order_days(spark, folder), STATUS)


@query(
    f"WITH m AS (SELECT month, total, lag(total) OVER (ORDER BY month) AS p FROM {_ORDER_MONTHS}), "
    "c AS (SELECT month, total, CASE WHEN p > 0 THEN CAST(round_even((total - p) / p * 100, 0) AS BIGINT) END AS change FROM m) "
    "SELECT month, total, change, CASE WHEN change >= 30 THEN 'up' WHEN change <= -30 THEN 'down' ELSE 'none' END AS trend FROM c"
)
def month_trend(spark, folder):
    return S.month_trend(K.month_totals(_order_days(spark, folder), STATUS)).select("month", "total", "change", "trend")


@query(
    f"WITH r AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS month, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY total DESC, date) AS k FROM {_ORDER_DAYS}) "
    "SELECT month, date, total, CAST(row_number() OVER (PARTITION BY month ORDER BY date) AS INTEGER) AS number FROM r WHERE k <= 4"
)
def top_days_in_order(spark, folder):
    return S.top_days_in_order(_order_days(spark, folder)).select("month", "date", "total", "number")


@query(f"SELECT date, CASE WHEN F >= O AND F >= P THEN 'F' WHEN O >= P THEN 'O' ELSE 'P' END AS dominant FROM {_ORDER_DAYS}")
def dominant_category(spark, folder):
    return _order_days(spark, folder).select("date", K.dominant_category(STATUS).alias("dominant"))


@query(
    f"WITH d AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS month FROM {_ORDER_DAYS}), "
    "r AS (SELECT month, date, O, row_number() OVER (PARTITION BY month ORDER BY O DESC, date) AS k FROM d) "
    "SELECT month, date AS peak_date, O AS peak FROM r WHERE k = 1"
)
def peak_day(spark, folder):
    return K.peak_day(_order_days(spark, folder), "O")


@query(
    f"WITH y AS (SELECT DISTINCT year(month) AS y FROM {_ORDER_MONTHS}), "
    "g AS (SELECT make_date(y, m, 1) AS month FROM y, (SELECT CAST(range AS BIGINT) AS m FROM range(1, 13))) "
    f"SELECT g.month, F, O, P, days, total, days IS NOT NULL AS has_data FROM g LEFT JOIN {_ORDER_MONTHS} t ON g.month = t.month"
)
def month_calendar(spark, folder):
    return M.month_calendar(K.month_totals(_order_days(spark, folder), STATUS))


@query(
    "WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY n DESC, value) AS rank FROM c) "
    "SELECT month, value, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"
)
def month_top_values(spark, folder):
    rows = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderpriority")
    return K.month_top_values(rows, "o_orderpriority", 3)


@query(
    "SELECT o_orderkey, CAST((year(o_orderdate) - 2023) * 12 + month(o_orderdate) - 9 AS INTEGER) AS ordinal, "
    "greatest(DATE '1996-01-01', least(DATE '1999-12-31', CAST(o_orderdate AS DATE))) AS clamped, "
    "CAST(o_orderdate AS DATE) + 1 AS next_day, strftime(o_orderdate, '%Y-W%W') AS week FROM orders"
)
def calendar_functions(spark, folder):
    day = F.to_date("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey", D.month_ordinal(day).alias("ordinal"),
        D.clamp_date(day, F.lit(dt.date(1996, 1, 1)), F.lit(dt.date(1999, 12, 31))).alias("clamped"),
        D.shift_day(day, 1).alias("next_day"), D.week_key(day).alias("week"),
    )


_MONTHS_SQL = "[" + ", ".join(f"'{n}'" for n in D.MONTH_NAMES) + "]"
_ALT_SQL = "[" + ", ".join(f"'{n}'" for n in D.MONTH_NAMES_ALT) + "]"
_DAYS_SQL = "[" + ", ".join(f"'{n}'" for n in D.DAY_NAMES) + "]"


@query(
    f"SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, {_DAYS_SQL}[isodow(o_orderdate)] AS day_name, "
    f"translate(CAST(day(o_orderdate) AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' ' || {_MONTHS_SQL}[month(o_orderdate)] || ' ' || "
    "translate(CAST(year(o_orderdate) AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS local_date, "
    f"CAST(day(o_orderdate) AS VARCHAR) || ' ' || {_ALT_SQL}[month(o_orderdate)] || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS label FROM orders"
)
def localised_dates(spark, folder):
    days = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    day = F.col("date")
    return days.select("date", D.localised_day_name(day).alias("day_name"), D.localised_date(day).alias("local_date"), D.date_label(day).alias("label"))


@query(
    f"SELECT date, CASE WHEN CAST(substr(time, 1, 2) AS INTEGER) < 5 THEN 'fajr' WHEN CAST(substr(time, 1, 2) AS INTEGER) < 12 THEN 'sabah' "
    f"WHEN CAST(substr(time, 1, 2) AS INTEGER) < 16 THEN 'zuhr' ELSE 'masaa' END AS phase, count(*) AS n FROM {EV} GROUP BY 1, 2"
)
def phase_counts(spark, folder):
    return K.phase_counts(events(spark, folder), "time")


@query(
    f"SELECT title, n, CASE WHEN n >= 7 THEN 3 WHEN n >= 4 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END AS level FROM (SELECT title, count(*) AS n FROM {EV} WHERE category = 'error' AND hour(ts) < 2 GROUP BY title)"
)
def intensity_levels(spark, folder):
    rows = events(spark, folder).where((F.col("category") == "error") & (F.hour("ts") < 2))
    return rows.groupBy("title").agg(F.count(F.lit(1)).alias("n")).withColumn("level", intensity_bucket(F.col("n")))


@query(f"SELECT date, time, category, title FROM {EV} WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-09 18:30:00' ORDER BY ts, id LIMIT 800")
def utc_window(spark, folder):
    from newsloom.sources.dumps import utc_window as window

    rows = window(events(spark, folder), dt.datetime(2024, 1, 5, 6), dt.datetime(2024, 1, 9, 18, 30), 800)
    return rows.select("date", "time", "category", "title")


@query(f"SELECT date, time, category, title FROM {EV}")
def raw_export(spark, folder):
    return events(spark, folder).select("date", "time", "category", "title", "id").orderBy("date", "time", "id").drop("id")


@query(
    f"SELECT date, count(*) FILTER (WHERE category = 'purchase') AS statements, count(*) FILTER (WHERE category = 'purchase' AND value > 20) AS hits, "
    f"count(*) FILTER (WHERE category = 'purchase' AND user_id % 5 = 0) AS tanks, count(*) FILTER (WHERE category = 'purchase' AND user_id % 5 = 1) AS aircraft, "
    f"count(*) FILTER (WHERE category = 'purchase' AND user_id % 5 = 2) AS settlements, count(*) FILTER (WHERE category = 'purchase' AND user_id % 5 = 3) AS bases, "
    f"count(*) FILTER (WHERE category = 'error') AS alerts FROM {EV} GROUP BY date"
)
def headline_counts(spark, folder):
    bucket = F.col("user_id") % 5
    return K.headline_counts(
        events(spark, folder), bucket == 0, F.col("value") > 20, bucket == 1, bucket == 2, bucket == 3,
        F.col("category") == "purchase", F.col("category") == "error",
    )


@query(
    "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS t, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS k FROM orders) "
    "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS rows, count(*) FILTER (WHERE t = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (WHERE t = '2-HIGH') AS \"2-HIGH\", "
    "CAST(sum(CASE WHEN k > 0 THEN k - 1 ELSE 0 END) AS BIGINT) AS uplift FROM d GROUP BY 1"
)
def yearly_type_pivot(spark, folder):
    nested = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), "o_orderpriority")
    rows = orders.join(nested, orders.o_orderkey == nested.l_orderkey, "left")
    return K.yearly_type_pivot(rows, "o_orderpriority", ("1-URGENT", "2-HIGH"), F.col("k"))


@query(
    f"SELECT title, n, first_id FROM (SELECT title, count(*) AS n, min(id) AS first_id FROM {EV} GROUP BY title) ORDER BY n DESC, first_id LIMIT 25"
)
def most_common_values(spark, folder):
    return K.most_common(events(spark, folder), "title", F.col("id"), 25).withColumnRenamed("first_position", "first_id")
