"""Unions with precedence and differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_dedupe(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """G1: rows with equal keys are the same event, so any one is kept."""
    return reduce(lambda a, b: a.unionByName(b), parts).dropDuplicates(list(keys))


def union_by_priority(parts: Sequence[DataFrame], keys: Sequence[str], keep: str = "first") -> DataFrame:
    """One definition per key: that of the first or of the last part; inside
    a part the smallest ``priority`` (first) or the largest (last).

    An aggregate with map-side combine, so repeated keys shrink before the
    shuffle. Output columns: those of the first part."""
    columns = parts[0].columns
    tagged = reduce(
        lambda a, b: a.unionByName(b), [p.select(*columns, F.lit(i).alias("__part")) for i, p in enumerate(parts)]
    )
    order = F.struct("__part", *(["priority"] if "priority" in columns else []))
    choose = F.min_by if keep == "first" else F.max_by
    rest = [c for c in columns if c not in keys]
    return tagged.groupBy(*keys).agg(choose(F.struct(*rest), order).alias("__v")).select(*keys, "__v.*").select(*columns)


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the left side that the right side does not have."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def missing_days(data: DataFrame, index: DataFrame) -> DataFrame:
    """Days only in the data and days only in the index."""
    only_data = difference(data, index, ["date"]).withColumn("side", F.lit("not in index"))
    only_index = difference(index, data, ["date"]).withColumn("side", F.lit("no data"))
    return only_data.unionByName(only_index)
