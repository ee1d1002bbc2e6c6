"""Field extraction from statement, alert and media texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import LUNAR_DATE
from newsloom.functions.text import (
    INVISIBLE,
    MARKS_CORE,
    SPACES,
    SUPERSCRIPT_ALEF,
    TATWEEL,
    as_number,
    is_noise,
    let,
    norm_match,
    null_to_empty,
    squeeze,
    strip,
    strip_chars,
    strip_hashtags,
    truncate,
)
from newsloom.lexicon import categories as C
from newsloom.lexicon import extraction as X
from newsloom.operators.scale import pin
from newsloom.rules import Rule, contains_any, contains_rules, first_match, java_regex

NOISE, OTHER = "noise", "other"


def default_cascade() -> list[Rule]:
    """The category rules in order; ally rules carry their flag in the label."""
    rules = contains_rules("bayanat", C.STATEMENT_MARKERS) + contains_rules("sirens", C.ALERT_MARKERS)
    for flag, markers in C.ALLY_MARKERS.items():
        rules += contains_rules(f"allies/{flag}", markers)
    for label, markers in (
        ("iran", C.STATE_MARKERS), ("summaries", C.DIGEST_MARKERS),
        ("enemy", C.MEDIA_MARKERS), ("videos", C.VIDEO_MARKERS),
    ):
        rules += contains_rules(label, markers)
    return rules


def match_text(text: Column) -> Column:
    """The form the cascade tests: normalised and lower-cased."""
    return F.lower(norm_match(text))


def classify_route(text: Column, normal: Column, rules: Sequence[Rule] | None = None) -> Column:
    """H4: label of the first matching rule; noise first, the rest is ``other``.
    Substring patterns are lower-cased because the tested text is."""
    rules = default_cascade() if rules is None else rules
    lowered = [Rule(r.label, r.pattern.lower(), r.kind) if r.kind == "contains" else r for r in rules]
    return F.when(is_noise(text), F.lit(NOISE)).otherwise(first_match(normal, lowered, F.lit(OTHER)))


def route_category(route: Column) -> Column:
    return F.split(route, "/")[0]


def route_flag(route: Column) -> Column:
    return F.get(F.split(route, "/"), F.lit(1))


def pick_source(normal: Column, sources: Sequence[str] = C.STATE_SOURCES, default: str = C.STATE_DEFAULT_SOURCE) -> Column:
    """H5."""
    return first_match(normal, [Rule(s, s) for s in sources], F.lit(default))


def alert_location(text: Column) -> Column:
    """H6: place part of an alert; the first 80 characters if nothing is left."""
    rest = squeeze(F.regexp_replace(strip_hashtags(text), java_regex(C.ALERT_PREFIX), ""))
    return F.coalesce(F.nullif(rest, F.lit("")), truncate(text, 80))


def digest_kind(normal: Column) -> Column:
    """H7."""
    return first_match(normal, [Rule(k, m) for k, m in C.DIGEST_KINDS], F.lit("daily"))


def media_key(text: Column) -> Column:
    """Description without hashtags, marker symbol and quality words."""
    bare = strip(F.regexp_replace(strip_hashtags(text), java_regex(C.VIDEO_SYMBOL), ""))
    return F.regexp_replace(strip(F.regexp_replace(bare, java_regex(C.VIDEO_QUALITY), " ")), r"(?U)\s+", " ")


# -- statements ---------------------------------------------------------------


def statement_number(normal: Column) -> Column:
    """H8: 0 when the header has no number."""
    return F.coalesce(as_number(F.regexp_extract(normal, java_regex(C.STATEMENT_NUMBER), 1)), F.lit(0))


def is_general_statement(normal: Column) -> Column:
    return normal.contains(C.GENERAL_STATEMENT) & (F.regexp_extract(normal, java_regex(C.STATEMENT_NUMBER), 1) == "")


def statement_title(normal: Column) -> Column:
    """H9."""
    rules = [Rule(title, marker) for title, markers in C.GENERAL_TITLES for marker in markers]
    return first_match(normal, rules, F.lit(C.GENERAL_DEFAULT_TITLE))


def op_time(normal: Column) -> Column:
    """Zero-padded operation time, '' if none."""
    found = F.regexp_extract(normal, java_regex(C.OPERATION_TIME), 1)
    return F.when(F.length(found) == 4, F.concat(F.lit("0"), found)).otherwise(found)


def before(text: Column, pattern: str) -> Column:
    """The text in front of the first match (all of it without a match). Unlike
    a split, the replacement compiles its pattern once, not once per row."""
    return where_named(text, pattern, F.regexp_replace(text, java_regex(f"(?s)(?:{pattern}).*$"), ""), text)


def after(text: Column, pattern: str) -> Column:
    """The text behind the first match; for texts known to have one."""
    return F.regexp_replace(text, java_regex(f"(?s)^.*?(?:{pattern})"), "")


def where_named(text: Column, pattern: str, then: Column, otherwise: Column) -> Column:
    """``then`` where the text holds a word without which ``pattern`` can't match,
    else ``otherwise``: looking for a word is far cheaper than the pattern."""
    words = X.PATTERN_WORDS.get(pattern)
    if not words:
        return then
    return F.when(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), then).otherwise(otherwise)


def clean_body(text: Column) -> Column:
    """The text in front of a list, without verses, dates, times, preamble
    and day words."""

    def removed(body: Column) -> Column:
        body = before(body, X.LIST_TAIL)
        for pattern in X.BODY_REMOVALS:
            remove = lambda text, rx=pattern: F.regexp_replace(text, java_regex(rx.replace("{LUNAR}", LUNAR_DATE)), " ")
            body = let(body, lambda text, remove=remove, rx=pattern: where_named(text, rx, remove(text), text))
        return squeeze(body)

    return let(F.translate(text, INVISIBLE + MARKS_CORE + SUPERSCRIPT_ALEF + TATWEEL, ""), removed)


def clean_location(place: Column) -> Column:
    """A captured place without connectives and trailing clauses."""
    ends = F.lit(SPACES + X.LOCATION_ENDS)

    def trimmed(text: Column, at: int, pattern: str) -> Column:
        # A text that doesn't begin (end) with such a character needs no replacement.
        return F.when(~ends.contains(F.substring(text, at, 1)), text).otherwise(F.regexp_replace(text, java_regex(pattern), ""))

    loc = let(place, lambda t: trimmed(t, 1, X.LOCATION_LEADS))
    loc = let(loc, lambda t: squeeze(trimmed(t, -1, X.LOCATION_TAILS)))
    for pattern in (X.LOCATION_SOURCE, *X.LOCATION_CLAUSES):
        loc = let(loc, lambda t, rx=pattern: where_named(t, rx, F.regexp_replace(t, java_regex(rx), ""), t))

    def count(text: Column, char: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))

    def drop_open(text: Column) -> Column:
        return F.when(text.contains("(") & (count(text, "(") > count(text, ")")), strip(F.regexp_replace(text, r"\([^(]*$", ""))).otherwise(text)

    def drop_close(text: Column) -> Column:
        return F.when(text.contains(")") & (count(text, ")") > count(text, "(")), strip(F.regexp_replace(text, r"(?s)\).*$", ""))).otherwise(text)

    def cut(text: Column) -> Column:
        limit = X.LOCATION_LENGTH
        return F.when(F.length(text) > limit, F.regexp_replace(truncate(text, limit), r" [^ ]*$", "")).otherwise(text)

    return strip(let(let(let(loc, drop_open), drop_close), cut))


def _target_pattern(pattern: str) -> str:
    return java_regex(
        pattern.replace("{END}", X.END).replace("{VERBS}", X.VERBS).replace("{NOUNS}", X.PLACE_NOUNS)
    )


def extract_target(body: Column, patterns: Sequence[str] = X.TARGET_PATTERNS, group_size: int = 8) -> Column:
    """H13 on a body from ``clean_body``: the first pattern in order whose
    cleaned capture has three characters or more.

    Patterns are tried in groups, so a statement matched by an early pattern
    does not run the later ones, and the clean-up is written once per group.
    """

    def usable(capture: Column) -> Column:
        return strip(F.regexp_replace(clean_location(capture), java_regex(X.TARGET_OBJECT_PREFIX), ""))

    tries = []
    for i in range(0, len(patterns), group_size):
        captures = F.array(*[where_named(body, p, F.regexp_extract(body, _target_pattern(p), 1), F.lit("")) for p in patterns[i : i + group_size]])
        cleaned = F.transform(F.filter(captures, lambda c: c != ""), usable)
        tries.append(F.try_element_at(F.filter(cleaned, lambda c: F.length(c) >= 3), F.lit(1)))
    warned = body.rlike(java_regex(X.BORDER_WARNING[0])) | body.rlike(java_regex(X.BORDER_WARNING[1]))
    aircraft = F.when(body.rlike(java_regex(X.AIRCRAFT_PATTERN)), F.lit(X.AIRCRAFT_TARGET)).otherwise(F.lit(""))
    return F.when(warned, F.lit(X.BORDER_WARNING_TARGET)).otherwise(F.coalesce(*tries, aircraft))


def extract_weapon(normal: Column, labels: Sequence[tuple[str, str]] = X.WEAPON_LABELS) -> Column:
    """H14 on text from ``norm_match``; '' if nothing is named."""

    def fallback(word: Column) -> Column:
        excluded = word == ""
        for prefix in X.WEAPON_FALLBACK_NOT:
            excluded = excluded | word.startswith(prefix)
        return F.when(excluded, F.lit("")).otherwise(word)

    def searched(text: Column) -> Column:
        word = F.rtrim(F.regexp_extract(text, java_regex(X.WEAPON_FALLBACK), 1), F.lit(".،"))
        return first_match(text, [Rule(label, phrase) for phrase, label in labels], let(word, fallback))

    if not all(any(w in phrase for w in X.WEAPON_WORDS) for phrase, _ in labels):
        return searched(normal)
    named = lambda text: reduce(lambda a, b: a | b, [text.contains(w) for w in X.WEAPON_WORDS])
    return let(normal, lambda text: F.when(~named(text), F.lit("")).otherwise(searched(text)))


def classify_badge(text: Column) -> Column:
    """H15 on the raw text."""
    return first_match(text, [Rule(badge, w) for badge, words in C.BADGES for w in words], F.lit(""))


def extract_tags(text: Column, badge: Column) -> Column:
    """H16."""
    tags = [F.when(contains_any(text, words), F.lit(tag)) for tag, words in C.TAGS]
    deep, words = C.DEEP_TAG
    tags.append(F.when((badge == "deep") & contains_any(text, words), F.lit(deep)))
    return F.array_compact(F.array(*tags))


def classify_type(normal: Column, number: Column) -> Column:
    """Statement, narrative_recap, defensive, list_strikes, offensive."""
    statement = ((number == 0) & ~normal.contains(C.NUMBERED_HEADER)) | contains_any(normal, C.STATEMENT_TYPE_MARKERS)
    return (
        F.when(statement, "statement")
        .when(contains_any(normal, C.RECAP_MARKERS), "narrative_recap")
        .when(normal.rlike(java_regex(C.DEFENSIVE)), "defensive")
        .when(normal.rlike(java_regex(C.LIST_TYPE)), "list_strikes")
        .otherwise("offensive")
    )


# -- nested list items (K1) -----------------------------------------------------


def has_list(text: Column) -> Column:
    return where_named(text, X.LIST_MARKER, text.rlike(java_regex(X.LIST_MARKER)), F.lit(False))


def _item_fields(rest: Column) -> Column:
    """Split 'place weapon-phrase' at the first weapon preposition."""
    bare = strip_chars(rest, " .،\n\u200f")
    segment = F.regexp_replace(bare, java_regex(r"^في\s+"), "")

    def parts(seg: Column, head: Column) -> Column:
        found = F.struct(
            strip_chars(head, " ،-\n\u200f").alias("loc"),
            strip_chars(F.substring(seg, F.length(head) + 1, F.length(seg)), " .،\n\u200f").alias("phrase"),
        )
        whole = F.struct(seg.alias("loc"), F.lit("").alias("phrase"))
        return F.when(F.length(head) < F.length(seg), found).otherwise(whole)

    def kept(seg: Column) -> Column:
        return let(before(seg, X.ITEM_WEAPON), lambda head: parts(seg, head))

    return let(segment, kept)


def _raw_items(text: Column) -> Column:
    """``array<struct<opTime,rest>>`` of the items after the list marker; of the
    three written forms the first that occurs is taken."""
    body = let(after(text, X.LIST_MARKER), lambda t: before(t, X.LIST_STOP))
    body = strip_chars(body, " :\n\u200f")

    def timed(block: Column, time: str) -> Column:
        """Items are found in one pass and taken apart one by one."""
        whole, start = "(?m)" + time + X.ITEM_REST, java_regex(time)

        def ended(item: Column) -> Column:
            # Behind its first character an item goes on to the first full stop.
            return let(F.regexp_replace(item, "^" + start, ""), lambda rest: (
                F.when(rest == "", F.regexp_extract(item, java_regex(whole), 3))
                .when(rest.endswith(".") & (F.length(rest) > 1), F.rtrim(F.left(rest, F.length(rest) - 1), F.lit(SPACES)))
                .otherwise(rest)))

        return F.transform(
            F.regexp_extract_all(block, F.lit(java_regex(whole)), F.lit(0)),
            lambda item: F.struct(
                F.concat(F.lpad(F.regexp_extract(item, start, 1), 2, "0"), F.lit(":"), F.regexp_extract(item, start, 2)).alias("opTime"),
                ended(item).alias("rest"),
            ),
        )

    def shared_time(head: Column) -> Column:
        hour, minute = (F.regexp_extract(head, java_regex(X.ITEM_SHARED_TIME), k) for k in (1, 2))
        return F.when(hour != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute)).otherwise("")

    def shared(block: Column) -> Column:
        found = F.regexp_extract_all(block, F.lit(java_regex(X.ITEM_SHARED_BULLET)), F.lit(1))
        placed = F.filter(found, lambda r: _item_fields(r)["loc"] != "")
        time = let(before(text, X.LIST_MARKER), shared_time)
        return let(time, lambda at: F.transform(placed, lambda r: F.struct(at.alias("opTime"), r.alias("rest"))))

    def chosen(block: Column) -> Column:
        forms = [timed(block, X.ITEM_BULLET_TIME), timed(block, X.ITEM_INLINE_TIME)]
        tries = [let(form, lambda a: F.when(F.size(a) > 0, a)) for form in forms]
        return F.coalesce(*tries, shared(block))

    return let(body, chosen)


def parse_list_items(text: Column, target: Column, normal: Column) -> Column:
    """K1: ``array<struct<opTime,target,weapon>>`` of the items after a list
    marker. Null without a list."""
    head = before(text, X.LIST_MARKER)
    parent_weapon = F.coalesce(
        F.nullif(extract_weapon_of(head), F.lit("")), F.nullif(extract_weapon(normal), F.lit("")), F.lit("")
    )

    def cleaned(ctx: Column) -> Column:
        named = F.transform(ctx["raw"], lambda x: F.struct(x["opTime"], _item_fields(x["rest"]).alias("f")))
        named = F.transform(named, lambda x: F.struct(x["opTime"], x["f"], norm_match(x["f"]["phrase"]).alias("n")))
        return F.transform(
            named,
            lambda x: F.struct(
                x["opTime"].alias("opTime"),
                clean_location(F.when(x["f"]["loc"] == "", ctx["target"]).otherwise(x["f"]["loc"])).alias("target"),
                F.coalesce(
                    F.nullif(extract_weapon(x["n"]), F.lit("")), F.nullif(ctx["weapon"], F.lit("")), x["f"]["phrase"]
                ).alias("weapon"),
            ),
        )

    context = F.struct(_raw_items(text).alias("raw"), parent_weapon.alias("weapon"), target.alias("target"))
    return F.when(has_list(text), let(context, cleaned))


def list_item_rows(statements: DataFrame, text: str, target: str, normal: str) -> DataFrame:
    """K1 as a table function: one row per nested item, with the statement's
    columns and ``item_no, op_time, item_target, item_weapon``.

    Same result as ``parse_list_items`` exploded; the items are cleaned as
    columns instead of inside an array, which suits large lists."""
    listed = pin(
        statements.where(has_list(F.col(text))), __raw=_raw_items(F.col(text)),
        __parent=F.coalesce(
            F.nullif(extract_weapon_of(before(F.col(text), X.LIST_MARKER)), F.lit("")),
            extract_weapon(F.col(normal)),
        ),
    )
    items = listed.select(*statements.columns, "__parent", F.posexplode("__raw").alias("item_no", "__item"))
    items = pin(items, __f=_item_fields(F.col("__item.rest")))
    items = pin(items, __n=norm_match(F.col("__f.phrase")))
    loc = F.when(F.col("__f.loc") == "", F.col(target)).otherwise(F.col("__f.loc"))
    return items.select(
        *statements.columns, "item_no", F.col("__item.opTime").alias("op_time"), clean_location(loc).alias("item_target"),
        F.coalesce(F.nullif(extract_weapon(F.col("__n")), F.lit("")), F.nullif(F.col("__parent"), F.lit("")), F.col("__f.phrase"))
        .alias("item_weapon"),
    )


def extract_weapon_of(text: Column) -> Column:
    """H14 straight from raw text, normalised once."""
    return let(norm_match(text), extract_weapon)
