"""Day boundaries against a day-by-day walk over small random archives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import sequence as S
from newsloom.plans.quality import repair_boundaries

START = dt.date(2024, 1, 1)


def random_archive(seed):
    """Several runs of days; numbers restart near the end of many days."""
    rnd = random.Random(seed)
    archive, day = {}, START
    for _ in range(24):
        day += dt.timedelta(days=rnd.choice([1, 1, 1, 1, 2]))
        rows, n = [], rnd.randint(1, 9)
        base = rnd.choice([0, 0, 0, 8, 20])
        cut = rnd.choice([None, 0, n // 2, n - 1])
        for i in range(n):
            restarted = cut is not None and i >= cut
            num = (i - cut + 1) if restarted else base + i + 1
            late = restarted and rnd.random() < 0.9
            hour = rnd.randint(21, 23) if late or rnd.random() < 0.3 else rnd.randint(0, 20)
            if i == 0 and rnd.random() < 0.5:
                hour = rnd.randint(0, 2)
            badge = rnd.choice(["", "", "", "communique"])
            num = rnd.choice([num] * 6 + [0])
            rows.append({"key": f"{day}-{i}", "num": num, "time": f"{hour:02d}:{rnd.randint(0, 59):02d}", "badge": badge})
        archive[day] = rows
    return archive


def walk_forward(archive):
    """Numbers that fall by five or more open a tail; a tail of late rows goes to
    the next day. Days are visited in order and see what moved into them."""
    days = {d: list(r) for d, r in archive.items()}
    for day in sorted(archive):
        rows = days[day]
        marked = [i for i, r in enumerate(rows) if r["badge"] != "communique" and r["num"] > 0]
        cuts = [b for a, b in zip(marked, marked[1:]) if rows[a]["num"] - rows[b]["num"] >= 5]
        if cuts and all(r["time"] >= "21:00" or r["num"] <= 0 for r in rows[cuts[-1]:]):
            tail = rows[cuts[-1]:]
            days[day] = rows[: cuts[-1]]
            after = day + dt.timedelta(days=1)
            days[after] = tail + days.get(after, [])
    return days


def walk_back(days):
    days = {d: list(r) for d, r in days.items()}
    for day in sorted(days):
        before = days.get(day - dt.timedelta(days=1))
        if not days[day] or not before:
            continue
        first = days[day][0]
        if first["time"] < "02:00" and first["num"] > 3 and first["num"] - before[-1]["num"] in (1, 2):
            before.append(days[day].pop(0))
    return days


def as_frame(spark, archives):
    rows = []
    for shift, archive in enumerate(archives):  # archives far apart, so they do not touch
        for day, entries in archive.items():
            for i, e in enumerate(entries):
                rows.append((f"{shift}/{e['key']}", day + dt.timedelta(days=400 * shift), i, e["num"], e["time"], e["badge"]))
    return spark.createDataFrame(rows, "key string, date date, position long, num int, time string, badge string")


@pytest.fixture(scope="module")
def archives():
    return [random_archive(seed) for seed in range(60)]


def expected(archives, walk):
    out = {}
    for shift, archive in enumerate(archives):
        for day, rows in walk(archive).items():
            for i, r in enumerate(rows):
                out[f"{shift}/{r['key']}"] = (day + dt.timedelta(days=400 * shift), i)
    return out


def test_restart_equals_the_walk(spark, archives):
    want = expected(archives, walk_forward)
    got = {r["key"]: r["new_date"] for r in S.sequence_restart(as_frame(spark, archives), width=3).collect()}
    assert got == {k: d for k, (d, _) in want.items()}
    assert any(got[r["key"]] != r["date"] for r in as_frame(spark, archives).collect())


def test_both_repairs_equal_the_walks(spark, archives):
    want = expected(archives, lambda a: walk_back(walk_forward(a)))
    fixed = repair_boundaries(as_frame(spark, archives)).collect()
    assert {r["key"]: r["date"] for r in fixed} == {k: d for k, (d, _) in want.items()}
    order = {}
    for r in sorted(fixed, key=lambda r: (r["date"], r["position"])):
        order.setdefault(r["date"], []).append(r["key"])
    for day, keys in order.items():
        assert keys == sorted(keys, key=lambda k: want[k][1]), day


def test_gaps(spark):
    rows = spark.createDataFrame([("a", n) for n in (2, 3, 7, 7, 0, -4)] + [("b", 1), ("c", 0)], "k string, num int")
    got = sorted((r["k"], r["missing"]) for r in S.sequence_gaps(rows, ["k"], "num", width=2).collect())
    assert got == [("a", 1), ("a", 4), ("a", 5), ("a", 6)]
    assert [tuple(r) for r in S.out_of_range(rows, ["k"], "num").collect()] == [("a", -4)]


def test_related_events_of_a_hot_day(spark):
    rows = spark.range(2_000).select("id", F.lit(START).alias("date"), F.lpad((F.col("id") % 24).cast("string"), 2, "0").alias("time"))
    got = S.related_events(rows).groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.max("n"), F.count(F.lit(1))).first()
    assert tuple(got) == (3, 3, 2_000)
    one = S.related_events(rows).where("id = 23").orderBy("rank")
    assert [r["related_id"] for r in one.collect()] == [47, 71, 95]


def test_gap_ranges_of_a_huge_number(spark):
    """One row per gap; the numbers themselves are never listed."""
    rows = spark.createDataFrame([("a", 2), ("a", 2_147_483_647), ("a", 3)], "k string, n int")
    from newsloom.operators.sequence import sequence_gap_ranges

    assert sorted((r["first"], r["last"]) for r in sequence_gap_ranges(rows, ["k"], "n").collect()) == [(1, 1), (4, 2_147_483_646)]
