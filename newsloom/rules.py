"""Ordered rule tables compiled to column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import let
from newsloom.operators.scale import collect_lookup


@dataclass(frozen=True)
class Rule:
    """One (label, pattern) pair; position in the list is its priority."""

    label: str
    pattern: str
    kind: str = "contains"  # contains | regex | equals | prefix


def contains_rules(label: str, markers: Iterable[str]) -> list[Rule]:
    return [Rule(label, marker) for marker in markers]


def regex_rules(pairs: Iterable[tuple[str, str]]) -> list[Rule]:
    return [Rule(label, pattern, "regex") for label, pattern in pairs]


def rules_from_table(df: DataFrame, rule_set: str, max_rows: int = 5_000) -> list[Rule]:
    """Read one rule set from a ``rules`` table (see ``schemas.RULE``)."""
    chosen = df.where(F.col("rule_set") == rule_set)
    rows = sorted(collect_lookup(chosen, max_rows), key=lambda r: r["priority"])
    return [Rule(r["label"], r["pattern"], r["kind"]) for r in rows]


def java_regex(pattern: str) -> str:
    """Unicode classes, ``\\n`` as the only line end: ``\\s`` matches NBSP, ``\\d`` Arabic-Indic digits."""
    return "(?Ud)" + pattern


def matches(text: Column, rule: Rule) -> Column:
    if rule.kind == "contains":
        return text.contains(rule.pattern)
    if rule.kind == "regex":
        return text.rlike(java_regex(rule.pattern))
    if rule.kind == "equals":
        return text == F.lit(rule.pattern)
    if rule.kind == "prefix":
        return text.startswith(rule.pattern)
    raise ValueError(f"unknown rule kind {rule.kind!r}")


def contains_any(text: Column, markers: Sequence[str]) -> Column:
    """Any of the markers is a substring. Several markers become one
    alternation, which keeps the generated code small enough to be compiled."""
    if len(markers) < 3:
        return reduce(lambda a, b: a | b, [text.contains(m) for m in markers])
    return text.rlike("|".join(re.escape(m) for m in markers))


def matches_any(text: Column, rules: Sequence[Rule], bound: bool = False) -> Column:
    """``bound``: inside a lambda, where no code is generated, so plain searches
    for each marker are faster than one alternation."""
    plain = [r.pattern for r in rules if r.kind == "contains"]
    tests = [text.contains(m) for m in plain] if bound else [contains_any(text, plain)] if plain else []
    tests += [matches(text, r) for r in rules if r.kind != "contains"]
    return reduce(lambda a, b: a | b, tests)


LONG_CHAIN = 8


def first_match(text: Column, rules: Sequence[Rule], default: Column | None = None) -> Column:
    """Label of the first rule that matches; later branches are not evaluated.

    A long chain is bound to its text in a lambda: as generated code it would
    be one method too large for the JVM to compile."""
    groups: list[tuple[str, list[Rule]]] = []
    for rule in rules:
        if groups and groups[-1][0] == rule.label:
            groups[-1][1].append(rule)
        else:
            groups.append((rule.label, [rule]))
    last = default if default is not None else F.lit(None).cast("string")

    def chain(bound: Column) -> Column:
        out = None
        for label, members in groups:
            condition = matches_any(bound, members, len(groups) > LONG_CHAIN)
            out = F.when(condition, F.lit(label)) if out is None else out.when(condition, F.lit(label))
        return out.otherwise(last)

    return let(text, chain) if len(groups) > LONG_CHAIN else chain(text)


def all_matches(text: Column, rules: Sequence[Rule]) -> Column:
    """Every label with at least one matching rule, in rule order."""
    by_label: dict[str, list[Rule]] = {}
    for rule in rules:
        by_label.setdefault(rule.label, []).append(rule)
    return F.array_compact(
        F.array(*[F.when(matches_any(text, members), F.lit(label)) for label, members in by_label.items()])
    )


def count_mentions(text: Column, pattern: str) -> Column:
    """Number of matches of one pattern in the text."""
    return F.regexp_count(text, F.lit(java_regex(pattern)))


def listed_terms(text: Column, terms: Sequence[str]) -> Column:
    """Which of the listed terms occur in the text."""
    return F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in terms]))
