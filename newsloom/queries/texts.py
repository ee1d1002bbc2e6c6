"""Text, rule and date-phrase queries over documents, parts and conversations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from newsloom.functions import arrays as A
from newsloom.functions import classify as C
from newsloom.functions import dates as D
from newsloom.functions import text as X
from newsloom.functions import translit as L
from newsloom.operators import counts as K
from newsloom.plans import statistics as T
from newsloom.operators.aliases import resolve_from_table
from newsloom.queries.base import EV, events, query, table, text_table
from newsloom.rules import Rule, all_matches, count_mentions, first_match, listed_terms

_LOWER = {k: v for k, v in L.KEYBOARD.items() if k.islower() and len(v) == 1}
_KEYS, _LETTERS = "".join(_LOWER), "".join(_LOWER.values())
_TYPED = f"replace(translate(lower(p_name), '{_KEYS}', '{_LETTERS}'), 'b', 'لا')"


@query(f"SELECT p_partkey, {_TYPED} AS typed FROM part")
def keyboard_transliterate(spark, folder):
    return table(spark, folder, "part").select("p_partkey", L.keyboard_transliterate(F.lower("p_name")).alias("typed"))


def _replaced(column: str, table: dict[str, str]) -> str:
    for key, value in table.items():
        column = f"replace({column}, '{key}', '{value}')"
    return column


@query(f"SELECT p_partkey, {_replaced(_replaced('lower(p_name)', L.DIGRAPHS), L.LETTERS)} AS spoken FROM part")
def phonetic_transliterate(spark, folder):
    return table(spark, folder, "part").select("p_partkey", L.phonetic_transliterate(F.col("p_name")).alias("spoken"))


_INDEX_FROM, _INDEX_TO = "".join(X._INDEX_MAP), "".join(X._INDEX_MAP.values())
_STRIP = X.MARKS_WIDE + X.SUPERSCRIPT_ALEF


@query(
    f"WITH t AS (SELECT doc_id, text, 'أَهـلاً ١٢ ' || translate(lower(text), '{_KEYS}', '{_LETTERS}') AS typed FROM documents) "
    f"SELECT doc_id, md5(translate(typed, 'أإآى٠١٢٣٤٥٦٧٨٩{X.MARKS_CORE}{X.SUPERSCRIPT_ALEF}{X.TATWEEL}{X.INVISIBLE}', 'اااي0123456789')) AS h_match, "
    f"md5(lower(translate(typed, '{_INDEX_FROM}{_STRIP}', '{_INDEX_TO}'))) AS h_index, "
    f"md5(translate(typed, '{X.MARKS_CORE}', '')) AS h_place FROM t"
)
def normalise_text(spark, folder):
    typed = F.concat(F.lit("أَهـلاً ١٢ "), F.translate(F.lower("text"), _KEYS, _LETTERS))
    rows = text_table(spark, folder, "documents").select("doc_id", typed.alias("typed"))
    return rows.select(
        "doc_id", F.md5(X.norm_match(F.col("typed"))).alias("h_match"), F.md5(X.norm_index(F.col("typed"))).alias("h_index"),
        F.md5(X.norm_place(F.col("typed"))).alias("h_place"),
    )


ALIASES = {"ring": "حلقة", "red ring": "حلقة حمراء", "bolt": "برغي", "small": "صغير", "red": "أحمر"}


@query(
    "SELECT p_partkey, replace(replace(replace(replace(replace(lower(p_name), 'red ring', 'حلقة حمراء'), 'small', 'صغير'), 'ring', 'حلقة'), 'bolt', 'برغي'), 'red', 'أحمر') AS resolved FROM part"
)
def resolve_aliases(spark, folder):
    return table(spark, folder, "part").select("p_partkey", L.resolve_aliases(F.col("p_name"), ALIASES).alias("resolved"))


_CODE = "'o' || lpad(CAST({} AS VARCHAR), 9, '0')"


@query(
    f"WITH a AS (SELECT {_CODE.format('o_orderkey')} AS alias, lower(o_orderpriority) || ' of ' || o_custkey AS canonical FROM orders), "
    f"t AS (SELECT o_orderkey, {_CODE.format('o_orderkey')} AS own, {_CODE.format('o_orderkey + 1')} AS next FROM orders) "
    "SELECT t.o_orderkey, 'from ' || x.canonical || 'to' || coalesce(y.canonical, t.next) || '.' AS resolved "
    "FROM t JOIN a x ON x.alias = t.own LEFT JOIN a y ON y.alias = t.next"
)
def resolve_aliases_from_table(spark, folder):
    """An alias per order: more than a pattern can hold."""
    orders = table(spark, folder, "orders")
    code = lambda n: F.concat(F.lit("O"), F.lpad(n.cast("string"), 9, "0"))
    meaning = F.concat(F.lower("o_orderpriority"), F.lit(" of "), F.col("o_custkey").cast("string"))
    aliases = orders.select(code(F.col("o_orderkey")).alias("alias"), meaning.alias("canonical"))
    text = F.concat(F.lit("From "), code(F.col("o_orderkey")), F.lit("to"), code(F.col("o_orderkey") + 1), F.lit("."))
    return resolve_from_table(orders.select("o_orderkey", text.alias("q")), "q", aliases).select("o_orderkey", "resolved")


@query(
    "WITH p AS (SELECT p_partkey, p_name, generate_subscripts(string_split(p_name, ''), 1) AS i FROM part), "
    "h AS (SELECT p_partkey, CAST(i - 1 AS INTEGER) AS span_start, CAST(i + 2 AS INTEGER) AS span_end FROM p WHERE lower(substr(p_name, i, 3)) IN ('rin', 'bol')) SELECT * FROM h"
)
def match_spans(spark, folder):
    spans = X.match_spans(F.col("p_name"), ["rin", "bol"])
    return table(spark, folder, "part").select("p_partkey", F.explode(spans).alias("s")).select(
        "p_partkey", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end")
    )


MARKED, PLAIN_WORD, SHORT = "أَلْمُقَاوَمَةُ", "المقاومه", "مَا"
_AT = f"(SELECT *, CAST(length(p_name) + 1 AS INTEGER) AS a, CAST(length(p_name) + {len(MARKED) + 3} + length(CAST(p_partkey AS VARCHAR)) AS INTEGER) AS b FROM part)"


@query(
    f"SELECT p_partkey, a AS span_start, a + {len(MARKED)} AS span_end FROM {_AT} UNION ALL SELECT p_partkey, b, b + {len(PLAIN_WORD)} FROM {_AT} "
    f"UNION ALL SELECT p_partkey, b + {len(PLAIN_WORD) + 1}, b + {len(PLAIN_WORD) + 1 + len(SHORT)} FROM {_AT}"
)
def mapped_spans(spark, folder):
    """Matches on folded letters and dropped marks, at their original positions."""
    text = F.concat("p_name", F.lit(f" {MARKED}/"), F.col("p_partkey").cast("string"), F.lit(f" {PLAIN_WORD} {SHORT}"))
    rows = table(spark, folder, "part").select("p_partkey", text.alias("text"))
    return rows.select("p_partkey", F.explode(X.mapped_spans(F.col("text"), ["المقاومة", "مَا", "x"])).alias("s")).select(
        "p_partkey", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@query(
    "SELECT doc_id, CASE WHEN contains(lower(text), 'http') THEN 'link' WHEN regexp_matches(text, '[0-9]{4}') THEN 'number' "
    "WHEN contains(lower(text), 'the') OR contains(lower(text), 'and') THEN 'english' ELSE 'other' END AS label FROM documents"
)
def classify_first_match(spark, folder):
    rules = [Rule("link", "http"), Rule("number", "[0-9]{4}", "regex"), Rule("english", "the"), Rule("english", "and")]
    return text_table(spark, folder, "documents").select("doc_id", first_match(F.lower("text"), rules, F.lit("other")).alias("label"))


@query(
    "WITH t AS (SELECT lower(text) AS t FROM conversations) SELECT label, count(*) AS n FROM (SELECT 'en' AS label FROM t WHERE contains(t, 'the') UNION ALL "
    "SELECT 'de' FROM t WHERE contains(t, 'der') OR contains(t, 'und') UNION ALL SELECT 'fr' FROM t WHERE contains(t, 'les') OR contains(t, 'que')) GROUP BY label"
)
def classify_all_labels(spark, folder):
    rules = [Rule("en", "the"), Rule("de", "der"), Rule("de", "und"), Rule("fr", "les"), Rule("fr", "que")]
    return K.multi_label_counts(text_table(spark, folder, "conversations"), all_matches(F.lower("text"), rules))


@query(
    "SELECT 'number' AS label, CAST(sum(len(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS n FROM documents UNION ALL "
    "SELECT 'the', CAST(sum(len(regexp_extract_all(text, 'the'))) AS BIGINT) FROM documents UNION ALL "
    "SELECT 'vowels', CAST(sum(len(regexp_extract_all(text, '[aeiou]{3}'))) AS BIGINT) FROM documents"
)
def document_mentions(spark, folder):
    return T.mention_counts(text_table(spark, folder, "documents"), [("number", "[0-9]+"), ("the", "the"), ("vowels", "[aeiou]{3}")], "text")


@query("SELECT CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events")
def captured_number_sum(spark, folder):
    return T.number_sum(table(spark, folder, "events"), r"(\d+)\s*\}", "props")


@query(
    "SELECT doc_id, array_to_string(list_filter(['the', 'der', 'les', 'http'], lambda x: contains(lower(text), x)), ',') AS terms FROM documents"
)
def listed_terms_present(spark, folder):
    found = listed_terms(F.lower("text"), ["the", "der", "les", "http"])
    return text_table(spark, folder, "documents").select("doc_id", F.array_join(found, ",").alias("terms"))


@query(
    "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS title, substr(text, 1, 200) AS summary FROM documents"
)
def display_titles(spark, folder):
    none = F.lit("")
    return text_table(spark, folder, "documents").select(
        "doc_id", X.display_title(none, F.col("text")).alias("title"), X.truncate(F.col("text"), 200).alias("summary")
    )


@query("SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 5 IN (0, 1, 2)) AS noise FROM part")
def drop_noise(spark, folder):
    kind = F.col("p_partkey") % 5
    text = (
        F.when(kind == 0, F.lit("‏​  ")).when(kind == 1, F.lit("‏[Media / No text]‏")).when(kind == 2, F.lit(None).cast("string"))
        .otherwise(F.col("p_name"))
    )
    return table(spark, folder, "part").agg(F.count(F.lit(1)).alias("n"), K.count_if(X.is_noise(text)).alias("noise"))


@query("SELECT p_partkey, p_name || ' end' AS plain, p_name AS facet FROM part")
def strip_marks(spark, folder):
    noisy = F.concat(F.lit("#tag "), F.col("p_name"), F.lit(" #عاجل end "))
    facet = F.concat(F.lit(" "), F.col("p_name"), F.lit("؟! . "))
    return table(spark, folder, "part").select(
        "p_partkey", X.squeeze(X.strip_hashtags(noisy)).alias("plain"), X.norm_facet(facet).alias("facet")
    )


@query(
    "SELECT o_orderkey, 'single' AS type, CAST(o_orderdate AS DATE) AS range_start, CAST(o_orderdate AS DATE) AS range_end, 'order' AS remaining FROM orders WHERE o_orderkey % 5 <> 4 "
    "UNION ALL SELECT o_orderkey, 'range', CAST(date_trunc('month', o_orderdate) AS DATE), CAST(last_day(o_orderdate) AS DATE), 'order' FROM orders WHERE o_orderkey % 5 = 4"
)
def extract_date_range(spark, folder):
    """Each order date written in one of five forms and read back."""
    day, form = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    month = F.lower(F.date_format(day, "MMM"))
    written = (
        F.when(form == 0, F.date_format(day, "yyyy-MM-dd")).when(form == 1, F.date_format(day, "d/M/yyyy"))
        .when(form == 2, F.concat(month, F.date_format(day, " d, yyyy"))).when(form == 3, D.localised_date(day))
        .otherwise(F.concat(month, F.date_format(day, " yyyy")))
    )
    rows = text_table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("order "), written).alias("q"))
    found = rows.select("o_orderkey", D.extract_date_range(F.col("q"), F.lit(dt.date(2024, 10, 10))).alias("d"))
    return found.select("o_orderkey", "d.type", F.col("d.start").alias("range_start"), F.col("d.end").alias("range_end"), "d.remaining")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'range' ELSE 'single' END AS type, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) - 1 "
    "WHEN 1 THEN CAST(o_orderdate AS DATE) - 9 ELSE CAST(o_orderdate AS DATE) - 14 END AS range_start, "
    "CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) - 1 WHEN 1 THEN CAST(o_orderdate AS DATE) - 9 ELSE CAST(o_orderdate AS DATE) - 6 END AS range_end FROM orders"
)
def relative_date_range(spark, folder):
    day, form = F.to_date("o_orderdate"), F.col("o_orderkey") % 3
    written = F.when(form == 0, F.lit("raids yesterday")).when(form == 1, F.lit("قبل ٩ أيام")).otherwise("2 weeks ago")
    rows = text_table(spark, folder, "orders").select("o_orderkey", day.alias("day"), written.alias("q"))
    rows = rows.select("o_orderkey", D.extract_date_range(F.col("q"), F.col("day")).alias("d"))
    return rows.select("o_orderkey", "d.type", F.col("d.start").alias("range_start"), F.col("d.end").alias("range_end"))


@query("SELECT o_orderkey, translate(CAST(day(o_orderdate) AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' رمضان ' || translate(CAST(year(o_orderdate) AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' هـ.' AS phrase FROM orders")
def lunar_dates(spark, folder):
    text = F.concat(F.lit("نص "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" رمضان "), F.year("o_orderdate").cast("string"), F.lit(" هـ والسلام"))
    return text_table(spark, folder, "orders").select("o_orderkey", D.lunar_date(text).alias("phrase"))


@query(
    "SELECT p_partkey, '[\"' || p_brand || '\",\"size:' || p_size || '\"]' AS tags_json, 'size' AS key, CAST(p_size AS VARCHAR) AS value, p_brand AS first_tag FROM part"
)
def tag_arrays(spark, folder):
    tags = F.array(F.col("p_brand"), F.concat(F.lit("size:"), F.col("p_size").cast("string")))
    repeated = F.concat(tags, tags)
    return table(spark, folder, "part").select(
        "p_partkey", A.tags_to_json(tags).alias("tags_json"), F.explode(A.split_kv_tags(tags)),
        F.get(A.ordered_distinct(repeated), F.lit(0)).alias("first_tag"),
    )


_FAMILY_TEXT = "['صاروخ موجّه', 'قذائف مدفعية', 'عبوة ناسفة', 'صليات صاروخية', 'شيء']"


@query(
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'الصواريخ_الموجهة' WHEN 1 THEN 'القذائف_المدفعية' WHEN 2 THEN 'سلاح_الهندسة' WHEN 3 THEN 'الأسلحة_الصاروخية' ELSE 'أخرى' END AS family, "
    "CASE p_partkey % 5 WHEN 0 THEN 'صاروخ موجه' WHEN 1 THEN 'قذائف مدفعية' WHEN 2 THEN 'عبوة ناسفة' WHEN 3 THEN 'صلية صاروخية' ELSE 'شيء' END AS canonical, "
    "CASE p_partkey % 3 WHEN 0 THEN NULL ELSE 'هدف ' || p_name END AS target FROM part"
)
def weapon_and_target_buckets(spark, folder):
    words = F.array(*[F.lit(w) for w in ("صاروخ موجّه", "قذائف مدفعية", "عبوة ناسفة", "صليات صاروخية", "شيء")])
    weapon = F.get(words, (F.col("p_partkey") % 5).cast("int"))
    badge = F.when(F.col("p_partkey") % 3 == 0, F.lit("communique")).otherwise("deep")
    return table(spark, folder, "part").select(
        "p_partkey", C.classify_weapon_family(weapon).alias("family"), C.canonical_weapon(weapon).alias("canonical"),
        C.clean_target(F.concat(F.lit(" هدف "), F.col("p_name")), badge).alias("target"),
    )


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'place' ELSE 'none' END AS in_list FROM part")
def place_in_list(spark, folder):
    inside = C.place_in_list(F.col("p_name"), ["ring", "zzz"])
    return table(spark, folder, "part").select("p_partkey", F.when(inside, "place").otherwise("none").alias("in_list"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\bthe\\b')) AS INTEGER) AS n FROM documents")
def word_mentions(spark, folder):
    return text_table(spark, folder, "documents").select("doc_id", count_mentions(F.col("text"), r"\bthe\b").alias("n"))


@query(f"SELECT id FROM {EV} WHERE contains(props, '7') AND category IN ('error', 'view')")
def keyword_filter(spark, folder):
    from newsloom.operators.events import keyword_filter as keep

    rows = events(spark, folder).where(F.col("category").isin("error", "view"))
    return rows.where(keep("r:7", F.col("props"))).select("id")
