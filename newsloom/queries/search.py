"""Search queries over documents, conversations and events."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from newsloom.operators import index as N
from newsloom.operators.counts import kpi_counts
from newsloom.operators.sets import difference, union_by_priority, union_dedupe
from newsloom.plans import search as P
from newsloom.queries.base import EV, events, query, table, text_table
from newsloom.session import work_dir

# Tokens as the engine makes them, in SQL.
_TOK = "' ' || trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _has(column: str, term: str) -> str:
    return f"contains({_TOK.format(column)}, ' {term}')"


def documents(spark, folder):
    """Documents as events: source is the category, the day follows from the id."""
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("doc_id") % 60).cast("int"))
    return text_table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), day.alias("date"), F.col("lang").alias("category"),
        F.lpad((F.col("doc_id") % 24).cast("string"), 2, "0").alias("time"),
        F.substring("text", 1, 80).alias("title"), F.lit(None).cast("string").alias("location"),
        F.col("source").alias("subtitle"), F.col("text").alias("full_text"),
    )


DOCS = (
    "(SELECT doc_id AS id, CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS DATE) AS date, lang AS category, lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') AS time, "
    "substr(text, 1, 80) AS title, source AS subtitle, text AS full_text FROM documents)"
)


@query(f"SELECT id FROM {DOCS} WHERE ({_has('full_text', 'ander')} OR {_has('title', 'ander')}) AND ({_has('full_text', 'the')} OR {_has('title', 'the')})")
def fts_prefix(spark, folder):
    return N.match_terms(documents(spark, folder), N.search_terms(["ander*", "the"])).select("id")


@query(f"SELECT id FROM {DOCS} WHERE ({_has('full_text', 'ander')} OR {_has('title', 'ander')}) AND ({_has('full_text', 'the')} OR {_has('title', 'the')})")
def fts_by_index(spark, folder):
    """The same search through the inverted index."""
    rows = documents(spark, folder)
    return N.match_terms_indexed(rows, N.build_postings(rows), ["ander", "the"]).select("id")


@query(f"SELECT id FROM {DOCS} WHERE ({_has('full_text', 'ander')} OR {_has('title', 'ander')}) AND ({_has('full_text', 'the')} OR {_has('title', 'the')})")
def search_stored_index(spark, folder):
    """The same through an index in the shared folder: the last day is added to it
    as a segment of its own, and found without a rebuild."""
    path = f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
    rows = documents(spark, folder)
    last = F.col("date") == F.lit(dt.date(2024, 2, 29))
    N.write_postings(N.build_postings(rows.where(~last)), path, spark.sparkContext.defaultParallelism)
    N.write_postings(N.build_postings(rows.where(last)), path, 1, segment="2024-02-29")
    return N.match_terms_indexed(rows, N.read_postings(spark, path), ["ander", "the"]).select("id")


@query(
    f"SELECT id, date, time FROM {DOCS} WHERE {_has('full_text', 'the')} OR {_has('title', 'the')} OR {_has('subtitle', 'the')} "
    f"OR contains(lower(full_text), 'eitu') OR contains(lower(title), 'eitu') OR contains(lower(subtitle), 'eitu') OR contains(lower(full_text), 'x')"
)
def search_variants(spark, folder):
    """Three variants in one scan: one found by its term, one by substrings because
    no token starts with it, one by substrings because it is a single character."""
    return P.match_variants(documents(spark, folder), [["the"], ["eitu"], ["x"]]).select("id", "date", "time")


@query(
    f"WITH t AS (SELECT DISTINCT id, unnest(string_split(trim({_TOK.format('full_text')}), ' ')) AS token FROM {DOCS}) "
    "SELECT token, count(*) AS docs FROM t WHERE token <> '' GROUP BY token"
)
def token_frequencies(spark, folder):
    postings = N.build_postings(documents(spark, folder), ("full_text",))
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("docs"))


@query(f"SELECT id FROM {DOCS} WHERE contains(lower(full_text), 'der') AND contains(lower(full_text), 'ung')")
def like_all_words(spark, folder):
    return N.like_all_words(documents(spark, folder), ["DER", "ung"], ("full_text",)).select("id")


@query("SELECT role AS category, count(*) AS n FROM conversations WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') GROUP BY role")
def all_words_filter(spark, folder):
    rows = text_table(spark, folder, "conversations").withColumnRenamed("role", "category")
    found, counts = P.in_page_search(rows, "text", "L'article ND", {"l'article": "the", "nd": "and"}, ("user", "assistant", "system"))
    return counts.select("category", "n").where("n > 0")


def _search_sql(terms: list[str], extra: str = "", limit: str = "") -> str:
    both = [f"({_has('full_text', t)} OR {_has('title', t)} OR {_has('subtitle', t)})" for t in terms]
    return (
        f"SELECT id, date, time FROM {DOCS} WHERE {' AND '.join(both)}{extra} ORDER BY date DESC, time DESC, id{limit}"
    )


# "and" is a reserved word of the term language, so it does not filter.
_FEBRUARY = " AND date BETWEEN DATE '2024-02-01' AND DATE '2024-02-29'"


@query(_search_sql(["the"], _FEBRUARY))
def search_text_in_month(spark, folder):
    return P.search(documents(spark, folder), "the and feb 2024", dt.date(2024, 3, 1)).select("id", "date", "time")


@query(_search_sql(["the"], _FEBRUARY, " LIMIT 80"))
def search_text_page(spark, folder):
    """What the search page fetches."""
    return P.search(documents(spark, folder), "the and feb 2024", dt.date(2024, 3, 1), limit=P.FETCH_LIMIT).select("id", "date", "time")


@query(f"SELECT id, date, time FROM {DOCS} WHERE date = DATE '2024-02-10' ORDER BY date, time, id")
def search_date_only(spark, folder):
    return P.search(documents(spark, folder), "2024-02-10", dt.date(2024, 3, 1)).select("id", "date", "time")


@query(
    f"SELECT id, date, time FROM {DOCS} WHERE contains(lower(full_text), 'eitu') OR contains(lower(title), 'eitu') ORDER BY date DESC, time DESC, id"
)
def search_substring_fallback(spark, folder):
    """No token starts with the word, so substrings are searched."""
    return P.query_events(documents(spark, folder), ["eitu"]).select("id", "date", "time")


@query(f"SELECT category, count(*) AS n FROM (SELECT * FROM {DOCS} WHERE {_has('full_text', 'ver')}) GROUP BY category")
def result_category_counts(spark, folder):
    found = N.match_terms(documents(spark, folder), ["ver"], ("full_text",))
    return kpi_counts(found, ("de", "en", "es", "fr")).select("category", "n").where("n > 0")


@query(f"SELECT CAST(greatest(count(*) - 40, 0) AS BIGINT) AS more FROM {DOCS} WHERE {_has('full_text', 'the')}")
def result_limit(spark, folder):
    return P.result_page(N.match_terms(documents(spark, folder), ["the"], ("full_text",)))[1]


@query(f"SELECT DISTINCT id FROM {EV} WHERE category = 'error' OR user_id % 7 = 0 OR contains(props, '9')")
def union_dedupe_results(spark, folder):
    rows = events(spark, folder)
    parts = [rows.where("category = 'error'"), rows.where("user_id % 7 = 0"), rows.where(F.col("props").contains("9"))]
    return union_dedupe([p.select("id", "date", "category") for p in parts], ["id"]).select("id")


_DEFINITIONS = (
    "SELECT p_name AS alias, p_brand AS canonical, CAST(p_partkey AS INTEGER) AS priority, 0 AS part FROM part WHERE p_size < 25 UNION ALL "
    "SELECT p_name, p_type, CAST(p_partkey AS INTEGER), 1 FROM part WHERE p_size >= 25"
)


def _definitions(spark, folder):
    part = table(spark, folder, "part")
    first = part.where("p_size < 25").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("canonical"), F.col("p_partkey").cast("int").alias("priority"))
    second = part.where("p_size >= 25").select(F.col("p_name").alias("alias"), F.col("p_type").alias("canonical"), F.col("p_partkey").cast("int").alias("priority"))
    return [first, second]


@query(f"SELECT alias, canonical, priority FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY part, priority) AS r FROM ({_DEFINITIONS})) WHERE r = 1")
def union_first_wins(spark, folder):
    return union_by_priority(_definitions(spark, folder), ["alias"], "first")


@query(f"SELECT alias, canonical, priority FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY part DESC, priority DESC) AS r FROM ({_DEFINITIONS})) WHERE r = 1")
def union_last_wins(spark, folder):
    return union_by_priority(_definitions(spark, folder), ["alias"], "last")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def difference_keys(spark, folder):
    orders = table(spark, folder, "orders")
    return difference(orders.where("o_orderpriority = '1-URGENT'"), orders.where("o_orderpriority = '5-LOW'"), ["o_custkey"])


@query(
    "SELECT event_type AS category, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-08' GROUP BY event_type"
)
def sql_over_tables(spark, folder):
    from newsloom.sources.reports import scan_date_range
    from newsloom.sources.reports import sql_over_tables as run

    rows = scan_date_range(events(spark, folder), dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    text = "SELECT category, count(*) AS n FROM archive_events WHERE date BETWEEN :a AND :b GROUP BY category"
    return run(spark, {"archive_events": rows}, text, {"a": dt.date(2024, 1, 3), "b": dt.date(2024, 1, 7)})


@query(f"SELECT category, count(*) AS n FROM {EV} WHERE date >= DATE '2024-01-01' AND date < DATE '2024-02-01' GROUP BY category")
def scan_month(spark, folder):
    from newsloom.sources.reports import scan_month as month

    return month(events(spark, folder), 2024, 1).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, date, category FROM {EV} WHERE date = DATE '2024-01-07' AND category = 'view'")
def filtered_results(spark, folder):
    from newsloom.operators.events import category_filter, date_filter, valid_time

    rows = events(spark, folder).where(date_filter("single", dt.date(2024, 1, 7), dt.date(2024, 1, 7)))
    return rows.where(category_filter("view") & category_filter("all") & valid_time(F.col("time"))).select("id", "date", "category")


