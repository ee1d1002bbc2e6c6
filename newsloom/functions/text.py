"""Text normalisation and clean-up as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: character classes of the archive's script -------------
INVISIBLE = "".join(chr(c) for c in [*range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, 0xFEFF, 0x00A0])
MARKS_CORE = "".join(chr(c) for c in range(0x064B, 0x0653))
MARKS_WIDE = "".join(chr(c) for c in range(0x064B, 0x0660))
SUPERSCRIPT_ALEF = "\u0670"
TATWEEL = "\u0640"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "0123456789"
SPACES = "".join(chr(c) for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
MEDIA_PLACEHOLDERS = ("[media/no text]", "[media / no text]")
# ---------------------------------------------------------------------------


def fold(text: Column, mapping: dict[str, str], drop: str = "") -> Column:
    """One character pass: map single characters, delete ``drop``."""
    source, target = "".join(mapping), "".join(mapping.values())
    return F.translate(text, source + drop, target)


def _digits_to_ascii() -> dict[str, str]:
    return dict(zip(ARABIC_DIGITS, ASCII_DIGITS))


def localise_digits(text: Column) -> Column:
    return F.translate(text, ASCII_DIGITS, ARABIC_DIGITS)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS, ASCII_DIGITS)


def norm_match(text: Column) -> Column:
    """Form used for every marker and pattern test."""
    mapping = {"أ": "ا", "إ": "ا", "آ": "ا", "ى": "ي", **_digits_to_ascii()}
    return fold(F.coalesce(text, F.lit("")), mapping, INVISIBLE + MARKS_CORE + SUPERSCRIPT_ALEF + TATWEEL)


_INDEX_MAP = {"إ": "ا", "أ": "ا", "آ": "ا", "ٱ": "ا", "ة": "ه", "ى": "ي", "ؤ": "و", "ئ": "ي"}


def norm_index(text: Column) -> Column:
    """Form stored in the search index."""
    return F.lower(fold(text, _INDEX_MAP, MARKS_WIDE + SUPERSCRIPT_ALEF))


def norm_highlight(text: Column) -> Column:
    """As H1b, superscript alef kept."""
    return F.lower(fold(text, _INDEX_MAP, MARKS_WIDE))


def norm_facet(text: Column) -> Column:
    """H1d: trim, drop trailing punctuation, drop marks."""
    bare = F.regexp_replace(text, r"(?U)^\s+|[\s.،,؟?!]+$", "")
    return F.regexp_replace(fold(bare, {}, MARKS_WIDE + SUPERSCRIPT_ALEF), r"(?U)^\s+|\s+$", "")


def norm_place(text: Column) -> Column:
    """H1e: marks dropped, letters kept."""
    return fold(F.coalesce(text, F.lit("")), {}, MARKS_CORE)


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U) \s+|[\s&&[^ ]]\s*", " "))  # a single blank needs no replacement


def strip(text: Column) -> Column:
    """Trim all Unicode white space (not only blanks)."""
    return strip_chars(text, SPACES)


def strip_hashtags(text: Column) -> Column:
    """H2."""
    return strip(F.regexp_replace(text, r"(?U)#\S+", ""))


def truncate(text: Column, length: int) -> Column:
    """H3: first ``length`` characters."""
    return F.substring(text, 1, length)


def is_noise(text: Column) -> Column:
    """Nothing left after removing invisible marks, or only a media placeholder."""
    whole = F.coalesce(text, F.lit(""))
    bare = F.lower(F.translate(whole, INVISIBLE, ""))
    named = reduce(lambda a, b: a | b, [bare.contains(marker) for marker in MEDIA_PLACEHOLDERS])
    return ~whole.rlike(rf"(?U)[^\s{INVISIBLE}]") | F.when(whole.contains("["), named).otherwise(F.lit(False))


def display_title(*candidates: Column, length: int = 80) -> Column:
    """First non-empty candidate, cut with an ellipsis."""
    chosen = F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))
    return F.when(F.length(chosen) > length, F.concat(truncate(chosen, length), F.lit("..."))).otherwise(chosen)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def as_number(text: Column, dtype: str = "int") -> Column:
    """Number of a digit string, null for ''. The empty string is tested first:
    a failed cast costs an exception per row."""
    return F.nullif(text, F.lit("")).try_cast(dtype)


def null_to_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def has_latin(text: Column) -> Column:
    """H21."""
    return text.rlike("[a-zA-Z]")


def split_at(text: Column, pattern: str) -> Column:
    """Pieces between the matches. The matches become one control character
    first: that pattern is compiled once, and a one-character split needs none."""
    return F.split(F.regexp_replace(text, pattern, "\u0001"), "\u0001", -1)


def match_spans(text: Column, terms: list[str]) -> Column:
    """``[start, end)`` of every normalised match in the original text.

    The terms are widened into a pattern over the *original* characters: each
    letter accepts the letters folded onto it and any dropped marks after it.
    Positions come from the lengths of the pieces between matches, so the whole
    text is processed without leaving the JVM.
    """
    pattern = spans_pattern(terms)
    return _no_spans() if pattern is None else _spans(text, pattern)


def offset_map(text: Column) -> Column:
    """For each character of ``norm_highlight(text)`` its position in the
    original. A dropped mark has no entry, a letter whose lower case is two
    characters has two."""
    return F.flatten(F.transform(F.split(text, "", -1), lambda ch, i: F.array_repeat(i, F.length(norm_highlight(ch)))))


def mapped_spans(text: Column, terms: list[str]) -> Column:
    """H23 by the folded text: terms are searched in ``norm_highlight(text)`` and
    the matches brought back through ``offset_map``. A match reaches to the next
    kept character, so it takes its marks along; marks in front of it stay outside. Null text and no usable term give no span."""
    import re

    folded = [t for t in (_fold_python(term) for term in terms) if len(t) > 1]
    if not folded:
        return _no_spans()
    pattern = "(?:" + "|".join(re.escape(t) for t in folded) + ")"
    return let(_spans(norm_highlight(text), pattern), lambda spans: F.when(F.size(spans) == 0, spans).otherwise(
        let(offset_map(text), lambda at: F.transform(spans, lambda s: F.struct(
            F.get(at, s["start"]).alias("start"), F.coalesce(F.get(at, s["end"]), F.length(text)).alias("end"))))))


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int>>")


def _spans(text: Column, pattern: str) -> Column:
    """``[start, end)`` of the matches of a pattern that matches no empty text."""
    empty = _no_spans()
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = split_at(text, pattern)
    steps = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).alias("g"), F.length(hit).alias("m"))
    )
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    walked = F.aggregate(
        steps,
        start,
        lambda acc, step: F.struct(
            (acc["at"] + step["g"] + step["m"]).alias("at"),
            F.concat(
                acc["spans"],
                F.array(F.struct((acc["at"] + step["g"]).alias("start"), (acc["at"] + step["g"] + step["m"]).alias("end"))),
            ).alias("spans"),
        ),
    )["spans"]
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def _fold_python(term: str) -> str:
    table = {ord(k): v for k, v in _INDEX_MAP.items()}
    table.update({ord(c): None for c in MARKS_WIDE})
    return term.translate(table).lower()


def spans_pattern(terms: list[str]) -> str | None:
    """Alternation of the widened terms, in the order given."""
    import re

    folded = [t for t in (_fold_python(term) for term in terms) if len(t) > 1]
    if not folded:
        return None
    classes: dict[str, str] = {}
    for variant, base in _INDEX_MAP.items():
        classes[base] = classes.get(base, base) + variant
    optional = f"[{MARKS_WIDE}]*"
    widened = []
    for term in folded:
        widened.append("".join((f"[{classes[c]}]" if c in classes else re.escape(c)) + optional for c in term))
    return "(?iu)(?:" + "|".join(widened) + ")"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``; needed
    inside lambdas, where common subexpressions are not shared."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def strip_chars(text: Column, chars: str) -> Column:
    """Trim a set of characters from both ends."""
    return F.btrim(text, F.lit(chars))
