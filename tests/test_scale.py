"""Bucketed numbering, carrying and list building against plain Python, with
one group that holds most rows and with null keys."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import scale as S


@pytest.fixture(scope="module")
def rows():
    random.seed(3)
    ids = random.sample(range(20_000), 1_200)
    return [(i, random.choice(["a"] * 6 + ["b", None]), random.choice([None, None, random.randint(0, 9)])) for i in ids]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, v int").repartition(5)


def groups(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[1], []).append(r)
    return out


def test_number_rows(frame, rows):
    got = {r["id"]: r["position"] for r in S.number_rows(frame, ["k"], ["id"], [S.id_bucket("id", 128)]).collect()}
    want = {r[0]: i for g in groups(rows).values() for i, r in enumerate(g)}
    assert got == want


def test_carry_last(frame, rows):
    got = {r["id"]: r["p"] for r in S.carry_last(frame, ["k"], ["id"], [S.id_bucket("id", 128)], F.col("v"), "p").collect()}
    want = {}
    for g in groups(rows).values():
        last = None
        for r in g:
            want[r[0]] = last
            last = r[2] if r[2] is not None else last
    assert got == want


def test_collect_parts(frame, rows):
    parts = S.collect_parts(frame, ["k"], ["id"], [S.id_bucket("id", 128)], F.col("id"), "ids", 100).collect()
    joined = {}
    for p in sorted(parts, key=lambda p: p["part"]):
        assert len(p["ids"]) <= 100
        joined.setdefault(p["k"], []).extend(p["ids"])
    assert joined == {k: [r[0] for r in g] for k, g in groups(rows).items()}


def test_top_per_group_prunes_before_the_shuffle(frame):
    top = S.top_per_group(frame, ["k"], [F.asc("id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") >= 0 and "Partial" in plan
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 3


def test_lookup_bounds(spark):
    table = spark.range(30)
    with pytest.raises(ValueError):
        S.collect_lookup(table, 10)
    assert len(S.collect_lookup(table, 30)) == 30
    assert "broadcast" not in S.checked_broadcast(table, 10)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" in S.checked_broadcast(table, 50)._jdf.queryExecution().analyzed().toString().lower()


def test_number_listing_of_a_million(spark):
    """A day whose only statement has the number 1,000,000: rows of bounded size,
    all numbers in order, none left out."""
    from newsloom.plans.quality import number_issues

    docs = spark.createDataFrame(
        [("2024-01-02", [("", 1_000_000)]), ("2024-01-03", [("", 1), ("", 1), ("", -2), ("communique", 9), ("", 3)])],
        "file_date string, bayanat array<struct<badge:string,num:int>>")
    rows = number_issues(docs).collect()
    large = [r["message"] for r in rows if r["date"] == "2024-01-02"]
    start = "Missing bayan numbers in sequence: ["
    assert len(large) == 100 and max(map(len, large)) < 100_000 and all(m.startswith(start) for m in large)
    numbers = sorted(int(x) for m in large for x in m[len(start) : -1].split(", "))
    assert numbers == list(range(1, 1_000_000))
    assert sorted(r["message"] for r in rows if r["date"] == "2024-01-03") == [
        "Duplicate bayan numbers: [1]", "Extra bayan numbers outside expected range: [-2]", "Missing bayan numbers in sequence: [2]"]


def test_spread_by_rows(spark, tmp_path, monkeypatch):
    """A larger table is dealt into more tasks, not longer ones."""
    from newsloom.operators import scale

    monkeypatch.setattr(scale, "TASK_ROWS", 1_000)
    for rows in (20_000, 40_000):
        path = f"{tmp_path}/{rows}"
        spark.range(rows).coalesce(1).write.parquet(path)
        dealt = scale.spread(spark.read.parquet(path))
        sizes = [n for (n,) in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == rows and len(sizes) == rows // 1_000 and max(sizes) <= 2_000


def test_spread_is_steady(spark, tmp_path):
    """Between a small and a large table the rows of a task grow little."""
    from newsloom.operators import scale

    path = f"{tmp_path}/rows"
    spark.range(400_000).coalesce(1).write.parquet(path)
    dealt = scale.spread(spark.read.parquet(path))
    sizes = [n for (n,) in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 400_000 and max(sizes) <= 25_000
