"""Buckets of targets, weapons and counter-moves (H24-H27) and clean-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import norm_facet, norm_place, null_to_empty, strip
from newsloom.lexicon import statistics as V
from newsloom.rules import Rule, contains_any, first_match, java_regex, regex_rules


def place_in_list(text: Column, places: Sequence[str]) -> Column:
    """C11: the text names one of the places (marks ignored on both sides).

    The list is one literal array, searched in place: no join is needed."""
    if not places:
        return F.lit(False)
    names = F.array(*[norm_place(F.lit(p)) for p in places])
    return F.exists(names, lambda n: norm_place(text).contains(n))


def classify_target_type(
    target: Column, badge: Column, border_towns: Sequence[str] = (), known_settlements: Sequence[str] = ()
) -> Column:
    """Installations, then listed towns, then settlements, then positions."""
    installation = first_match(target, regex_rules(V.INSTALLATION_RULES))
    settlement = (badge == "settlement") | place_in_list(target, known_settlements) | target.rlike(
        java_regex(V.SETTLEMENT_RULE[1])
    )
    return F.when(null_to_empty(target) == "", F.lit(V.OTHER)).otherwise(
        F.coalesce(
            installation,
            F.when(place_in_list(target, border_towns), F.lit(V.COUNTER_ADVANCE_TYPE)),
            F.when(settlement, F.lit(V.SETTLEMENT_RULE[0])),
            F.when(target.rlike(java_regex(V.POSITION_RULE[1])), F.lit(V.POSITION_RULE[0])),
            F.lit(V.OTHER),
        )
    )


def classify_weapon_family(weapon: Column, families: Sequence[tuple[str, str]] = V.WEAPON_FAMILIES) -> Column:
    """H25."""
    return first_match(null_to_empty(weapon), regex_rules(families), F.lit(V.OTHER))


def counter_attack_kind(text: Column) -> Column:
    """Landing before advance; null for neither."""
    return F.when(text.rlike(java_regex(V.COUNTER_LANDING)), "landing").when(
        text.rlike(java_regex(V.COUNTER_ADVANCE)), "advance"
    )


def canonical_weapon(weapon: Column) -> Column:
    """Canonical name, the cleaned value, or null if it says nothing."""
    cleaned = norm_facet(weapon)
    rules = [Rule(name, p) for name, patterns in V.CANONICAL_WEAPONS for p in patterns]
    return F.when(
        (null_to_empty(weapon) != "") & ~weapon.isin(*V.WEAPON_DROPS) & (F.length(weapon) <= 50),
        F.nullif(F.coalesce(first_match(F.lower(cleaned), rules), cleaned), F.lit("")),
    )


def clean_target(target: Column, badge: Column) -> Column:
    """Null for noise, labels and communiqués."""
    bare = strip(null_to_empty(target))
    keep = (
        (null_to_empty(badge) != "communique") & ~bare.isin(*V.TARGET_DROPS)
        & ~bare.startswith(V.TARGET_LABEL_PREFIX) & (F.length(bare) >= 3)
    )
    return F.when(keep, bare)


def clean_tag(tag: Column) -> Column:
    """B11."""
    bare = strip(null_to_empty(tag))
    return F.when((bare != "") & ~bare.isin(*V.TAG_DROPS), bare)


def clean_location_value(location: Column) -> Column:
    """Locations shorter than five characters say nothing."""
    bare = strip(null_to_empty(location))
    return F.when(F.length(bare) >= 5, bare)


def badge_label(badge: Column) -> Column:
    """Display label of a badge; unknown badges show themselves."""
    return first_match(badge, [Rule(label, b, "equals") for b, label in V.BADGE_LABELS.items()], badge)


def keyword_label(text: Column, table: Sequence[tuple[str, Sequence[str]]], default: Column | None = None) -> Column:
    """First label of a keyword table (regions, outlets, topics)."""
    return first_match(text, [Rule(label, w) for label, words in table for w in words], default)


def keyword_labels(text: Column, table: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Every label of a keyword table."""
    return F.array_compact(F.array(*[F.when(contains_any(text, words), F.lit(label)) for label, words in table]))
