"""Array, map and JSON helpers of the export formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tags_to_json(tags: Column) -> Column:
    """K2: tag array as JSON text."""
    return F.to_json(F.coalesce(tags, F.array().cast("array<string>")))


def tags_from_json(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def split_kv_tags(tags: Column) -> Column:
    """K3: ``k:v`` entries of a tag array as a map; the last value of a key wins."""
    trimmed = F.transform(tags, lambda t: F.trim(t))
    pairs = F.filter(trimmed, lambda t: t.contains(":"))
    entries = F.transform(
        pairs, lambda t: F.struct(F.trim(F.split(t, ":")[0]).alias("key"), F.trim(F.split(t, ":")[1]).alias("value"))
    )
    merged = F.aggregate(
        entries,
        F.array().cast("array<struct<key:string,value:string>>"),
        lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)),
    )
    return F.map_from_entries(merged)


def ordered_distinct(values: Column) -> Column:
    """Distinct values in order of first appearance."""
    return F.array_distinct(values)


def non_empty(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def omit_empty(text: Column) -> Column:
    """K5: an empty value becomes null, which JSON output leaves out."""
    return F.nullif(text, F.lit(""))


def omit_empty_array(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)
