"""Search-text variants: aliases, keyboard layout, phonetics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import split_at
from newsloom.operators.scale import collect_lookup

# ---- fixed values: keyboard layout and letter sounds -----------------------
KEYBOARD = {
    "q": "ض", "w": "ص", "e": "ث", "r": "ق", "t": "ف", "y": "غ", "u": "ع", "i": "ه", "o": "خ", "p": "ح",
    "a": "ش", "s": "س", "d": "ي", "f": "ب", "g": "ل", "h": "ا", "j": "ت", "k": "ن", "l": "م",
    "z": "ئ", "x": "ء", "c": "ؤ", "v": "ر", "b": "لا", "n": "ى", "m": "ة",
    "Q": "َ", "W": "ً", "E": "ُ", "R": "ٌ", "T": "لإ", "Y": "إ", "U": "‘",
    "I": "÷", "O": "×", "P": "؛", "A": "ِ", "S": "ٍ", "D": "]", "F": "[", "G": "لأ",
    "H": "أ", "J": "ـ", "K": "،", "L": "/", "Z": "~", "X": "ْ", "C": "}", "V": "{", "B": "لآ",
    "N": "آ", "M": "’",
}
DIGRAPHS = {
    "sh": "ش", "ch": "ش", "th": "ث", "dh": "ذ", "kh": "خ", "gh": "غ", "zh": "ج",
    "aa": "ا", "ee": "ي", "oo": "و", "ou": "و", "ei": "ي", "ai": "ي", "au": "و", "ph": "ف", "qu": "ق",
}
LETTERS = {
    "a": "ا", "b": "ب", "c": "ك", "d": "د", "e": "ي", "f": "ف", "g": "ج", "h": "ه", "i": "ي", "j": "ج",
    "k": "ك", "l": "ل", "m": "م", "n": "ن", "o": "و", "p": "ب", "q": "ق", "r": "ر", "s": "س", "t": "ت",
    "u": "و", "v": "ف", "w": "و", "x": "كس", "y": "ي", "z": "ز",
}
# ---------------------------------------------------------------------------


def _spell(text: Column, table: dict[str, str]) -> Column:
    """Single characters in one pass, then the few that become two letters.
    Safe in sequence because no output is a Latin letter."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(text, "".join(single), "".join(single.values()))
    for key, value in table.items():
        if len(value) > 1:
            out = F.replace(out, F.lit(key), F.lit(value))
    return out


def keyboard_transliterate(text: Column) -> Column:
    """The letters at the same physical keys of the Arabic layout."""
    return _spell(text, KEYBOARD)


def phonetic_transliterate(text: Column) -> Column:
    """Digraphs first, then single letters."""
    out = F.lower(text)
    for pair, letter in DIGRAPHS.items():
        out = F.replace(out, F.lit(pair), F.lit(letter))
    return _spell(out, LETTERS)


def aliases_from_table(df: DataFrame, max_rows: int = 5_000) -> dict[str, str]:
    """``alias → canonical`` from a small table; a later row wins (see G3)."""
    return {r["alias"].lower(): r["canonical"] for r in collect_lookup(df.select("alias", "canonical"), max_rows)}


def resolve_aliases(text: Column, aliases: dict[str, str], whole_words: bool = False) -> Column:
    """One pass over the lower-cased text, longest alias first.

    The text is cut at the matches and re-joined with the canonical forms, so a
    replacement is never replaced again. By default an alias also matches
    inside a word; ``whole_words`` asks for word boundaries.
    """
    lowered = F.lower(text)
    if not aliases:
        return lowered
    keys = sorted(aliases, key=len, reverse=True)
    body = "|".join(re.escape(k) for k in keys)
    pattern = rf"(?U)\b(?:{body})\b" if whole_words else f"(?:{body})"
    table = F.create_map(*[F.lit(x) for k in keys for x in (k, aliases[k])])
    hits = F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0))
    gaps = split_at(lowered, pattern)
    pieces = F.zip_with(
        gaps, hits, lambda gap, hit: F.concat(gap, F.when(hit.isNull(), F.lit("")).otherwise(F.coalesce(F.try_element_at(table, hit), hit)))
    )
    return F.when(F.size(hits) > 0, F.array_join(pieces, "")).otherwise(lowered)
