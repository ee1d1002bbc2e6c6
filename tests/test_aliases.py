"""Aliases from a table: the joined way against the compiled one."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions.translit import resolve_aliases
from newsloom.operators.aliases import BLOCK, alias_keys, resolve_from_table


def plain(text, table):
    low, out, i = text.lower(), "", 0
    while i < len(low):
        key = max((k for k in table if low.startswith(k, i)), key=len, default="")
        out, i = out + (table[key] if key else low[i]), i + (len(key) or 1)
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    word = lambda low, high: "".join(rng.choice("abéح .") for _ in range(rng.randint(low, high)))
    table = {word(1, 6): word(0, 4).upper() for _ in range(60)}
    texts = [word(0, 60) for _ in range(200)] + [word(3 * BLOCK, 3 * BLOCK), "A" * (BLOCK + 1), "", "same aab", "same aab"]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, text string")
    aliases = spark.createDataFrame([(k.upper(), v) for k, v in table.items()] + [("", "x"), (None, "y")], "alias string, canonical string")
    return rows, aliases, table


def test_joined_is_leftmost_longest(tables):
    rows, aliases, table = tables
    for limit in (0, 500):
        got = resolve_from_table(rows, "text", aliases, compile_limit=limit).collect()
        assert len(got) == rows.count()
        for r in got:
            assert r["resolved"] == (None if r["text"] is None else plain(r["text"], table)), r


def test_whole_words_both_ways(tables):
    rows, aliases, _ = tables
    table = {r["key"]: r["canonical"] for r in alias_keys(aliases).collect()}
    joined = resolve_from_table(rows, "text", aliases, whole_words=True, compile_limit=0)
    both = joined.withColumn("compiled", resolve_aliases(F.col("text"), table, whole_words=True))
    assert both.where(~F.col("resolved").eqNullSafe(F.col("compiled"))).collect() == []


def test_repeated_aliases_and_no_alias(spark):
    rows = spark.createDataFrame([(1, "Red ring")], "id int, text string")
    twice = spark.createDataFrame([("RED", "x"), ("red", "y"), ("ring", None)], "alias string, canonical string")
    for limit in (0, 500):
        assert [r["resolved"] for r in resolve_from_table(rows, "text", twice, compile_limit=limit).collect()] == ["y "]
    assert [r["resolved"] for r in resolve_from_table(rows, "text", twice.limit(0)).collect()] == ["red ring"]


def test_plan_has_no_product(spark, tables):
    rows, aliases, _ = tables
    plan = resolve_from_table(rows, "text", aliases, compile_limit=0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
