"""Searches in one scan and through a stored index, against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import index as N
from newsloom.plans import search as P

WORDS = ["foo", "foobar", "bar", "rfoo", "نهر", "x", "a1", "the", "barfly"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(4)
    data = [(k, dt.date(2024, 1, 1 + k % 9), f"{k % 24:02}:00" if k % 5 else None, "c", *[" ".join(draw.choices(WORDS, k=draw.randrange(1, 4))) if draw.random() < 0.6 else None for _ in range(4)])
            for k in range(300)]
    return spark.createDataFrame(data, "id long, date date, time string, category string, title string, full_text string, location string, subtitle string").cache()


def plain(rows, words):
    data = rows.collect()
    fields = lambda r: [(r[f] or "").lower() for f in N.FIELDS]
    if all(len(w) > 1 for w in words):
        hits = [r["id"] for r in data if all(any(t.startswith(w) for f in fields(r) for t in f.split()) for w in words)]
        if hits:
            return set(hits)
    return {r["id"] for r in data if all(any(w in f for f in fields(r)) for w in words)}


@pytest.mark.parametrize("variants", [[["foo"]], [["arfl"], ["foo", "bar"]], [["x"], ["zzz"], ["foobar", "the"]], [["oob", "the"], ["a1"]]])
def test_variants_in_one_scan(rows, variants):
    found = [r["id"] for r in P.match_variants(rows, variants).collect()]
    assert len(found) == len(set(found)) and set(found) == set().union(*[plain(rows, v) for v in variants])


def test_limit_counts_for_each_variant(rows):
    newest = lambda ids: [r["id"] for r in rows.where(F.col("id").isin(list(ids))).orderBy(*P._newest()).limit(5).collect()]
    found = sorted(r["id"] for r in P.match_variants(rows, [["foo"], ["arfl"]], 5).collect())
    assert found == sorted(newest(plain(rows, ["foo"])) + newest(plain(rows, ["arfl"])))


def test_a_search_reads_the_table_twice_at_most(spark, tmp_path, rows):
    rows.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    found = P.search(table, "river", dt.date(2024, 1, 1), limit=P.FETCH_LIMIT)  # three variants
    assert len(P.interpret(spark, "river", dt.date(2024, 1, 1))["variants"]) == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 2 and plan.count("Relation") <= 2


def test_index_in_segments(spark, tmp_path, rows):
    """A day added later is found; a segment written twice counts once; merging
    changes nothing; the token range reaches the files."""
    path = str(tmp_path / "index")
    N.write_postings(N.build_postings(rows.where("id < 200")), path, 3)
    for _ in range(2):
        N.write_postings(N.build_postings(rows.where("id >= 200")), path, 1, segment="later")
    N.merge_postings(spark, path, str(tmp_path / "merged"), 2)
    for folder in (path, str(tmp_path / "merged")):
        postings = N.read_postings(spark, folder)
        assert postings.count() == N.build_postings(rows).count()
        for terms in (["foo"], ["foo", "bar"], ["the", "a1", "foobar"]):
            got = {r["id"] for r in N.match_terms_indexed(rows, postings, terms).collect()}
            assert got == {r["id"] for r in N.match_terms(rows, terms).collect()} and max(got) >= 200
    plan = N.lookup(N.read_postings(spark, path), ["foo"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,foo)" in plan


def test_more_terms_than_bits(rows):
    many = [f"t{k}" for k in range(80)]
    one = rows.limit(1).select(F.lit(1).cast("long").alias("id"), *[F.lit(" ".join(many) if f == "title" else None).cast("string").alias(f) for f in N.FIELDS])
    postings = N.build_postings(one)
    assert N.lookup(postings, many).count() == 1 and N.lookup(postings, [*many, "other"]).count() == 0
