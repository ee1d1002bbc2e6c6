"""The pairs of raw dumps and daily documents: same messages, same fields."""

import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from newsloom.operators.places import alert_points, coords_by_day, geocode
from newsloom.plans.ingest import ingest
from newsloom.sinks.reports import MEMBERS, day_documents, point_lists
from newsloom.sources.reports import read_reports, readable, report_points, to_events, to_report_rows


@pytest.fixture(scope="module")
def pairs(archive):
    daily = {os.path.basename(p)[:10]: json.load(open(p, encoding="utf-8")) for p in glob.glob(f"{archive}/data/????-??-??.json")}
    raw = [p for p in glob.glob(f"{archive}/raw/????-??-??.json") if os.path.basename(p)[:10] in daily]
    return raw, daily


@pytest.fixture(scope="module")
def ingested(spark, pairs):
    items, headers = ingest(spark, pairs[0])
    return items.cache(), headers


def test_every_item_of_the_pairs(pairs, ingested):
    raw, daily = pairs
    items, _ = ingested
    got = {}
    for row in items.collect():
        day = row["date"].isoformat()
        entry = {m: row[c] for m, c in MEMBERS[row["category"]].items()}
        got.setdefault((day, row["category"]), []).append((row["position"], entry))
    days = {os.path.basename(p)[:10] for p in raw}
    compared = 0
    for day in sorted(days):
        for category in MEMBERS:
            expected = daily[day].get(category) or []
            mine = [e for _, e in sorted(got.get((day, category), []), key=lambda x: x[0])]
            assert len(mine) == len(expected), (day, category)
            for have, want in zip(mine, expected):
                have = {k: v for k, v in have.items() if not (k == "strikes" and v is None)}
                assert have == want, (day, category)
                compared += 1
    assert compared == 79


def test_documents_equal_the_files(pairs, ingested):
    raw, daily = pairs
    items, headers = ingested
    days = {os.path.basename(p)[:10] for p in raw}
    for doc in day_documents(items, headers).collect():
        if doc["date"] not in days:
            continue
        want = daily[doc["date"]]
        assert doc["dayAr"] == want["dayAr"] and doc["dateAr"] == want["dateAr"]
        assert {k: doc["stats"][k] for k in MEMBERS} == {**{k: 0 for k in MEMBERS}, **want["stats"]}


def test_events_and_reports(spark, archive, pairs):
    reports = read_reports(spark, f"{archive}/data")
    events = to_events(reports)
    counts = {r["category"]: r["count"] for r in events.groupBy("category").count().collect()}
    assert counts == {"enemy": 494, "allies": 201, "videos": 43, "iran": 39, "sirens": 39, "bayanat": 9}
    rows = to_report_rows(reports)
    assert rows.count() == 134
    assert rows.agg(F.sum("total")).first()[0] == 825


def test_points_are_reproduced(spark, archive, pairs):
    """Geocoding with the places found in the files gives back their points."""
    _, daily = pairs
    reports = read_reports(spark, f"{archive}/data")
    points = report_points(reports)
    gazetteer = coords_by_day(points, "first").select(F.col("loc").alias("name"), "lat", "lng").withColumn("priority", F.monotonically_increasing_id().cast("int"))
    alerts = to_events(readable(reports)).where("category = 'sirens'").withColumn("position", F.col("src_idx"))
    found = geocode(alerts, "location", gazetteer, "longest")
    lists = point_lists(alert_points(found))
    got = {r["date"].isoformat(): {(p["loc"], tuple(p["times"]), p["count"]) for p in r["sirenPoints"]} for r in lists.collect()}
    want = {d: {(p["loc"], tuple(p["times"]), p["count"]) for p in doc["sirenPoints"]} for d, doc in daily.items() if doc["sirenPoints"]}
    assert got == want


def test_rerun_skips_known_days(spark, pairs):
    raw, daily = pairs
    known = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in daily], "date date")
    items, _ = ingest(spark, raw, existing=known, stage=False)
    assert items.where(F.col("date").isin([dt.date.fromisoformat(os.path.basename(p)[:10]) for p in raw])).count() == 0
