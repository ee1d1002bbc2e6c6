"""From dump files to documents and back, on a small archive of its own."""

import datetime as dt
import json

from pyspark.sql import functions as F

from newsloom.functions.dates import lunar_date
from newsloom.plans.ingest import ingest_documents
from newsloom.sinks.reports import write_day_documents
from newsloom.sources.dumps import parse_record_header, read_day_records
from newsloom.sources.reports import read_written_reports, report_points, to_events, to_report_rows

LINE = "ID: {} | channel | Date: {} {}+00:00 | views:3 | Message: {}"
ALERT = "#عاجل صفارات الإنذار تدوي في الوادي"
NEWS = "القناة 12 خبر {}"


def dump(folder, day, texts):
    lines = [LINE.format(100 * int(day[-2:]) + k, day, f"{k // 60:02}:{k % 60:02}:00", t) for k, t in enumerate(texts)]
    (folder / f"{day}.json").write_text(json.dumps({"result": "\n".join(lines)}, ensure_ascii=False), encoding="utf-8")


def test_two_runs_keep_all_days(spark, tmp_path):
    raw, data = tmp_path / "raw", str(tmp_path / "data")
    raw.mkdir()
    places = spark.createDataFrame([("الوادي", 33.0, 35.0, 0)], "name string, lat double, lng double, priority int")
    dump(raw, "2024-01-02", [NEWS.format(k) for k in range(7)] + [ALERT] * 5 + ["بلا موضوع"])
    write_day_documents(ingest_documents(spark, str(raw), places, part_size=3), data)
    dump(raw, "2024-01-03", [ALERT, NEWS.format(1)])
    known = spark.createDataFrame([(dt.date(2024, 1, 2),)], "date date")
    write_day_documents(ingest_documents(spark, str(raw), places, known, part_size=3), data)

    reports = read_written_reports(spark, data)
    events = to_events(reports).orderBy("id").collect()
    assert [(str(e["date"]), e["category"], e["src_idx"]) for e in events] == [
        *[("2024-01-02", "sirens", k) for k in range(5)], *[("2024-01-02", "enemy", k) for k in range(7)],
        ("2024-01-03", "sirens", 0), ("2024-01-03", "enemy", 0)]
    assert len({e["id"] for e in events}) == len(events)
    assert sorted((str(r["date"]), r["sirens"], r["enemy"], r["total"]) for r in to_report_rows(reports).collect()) == [
        ("2024-01-02", 5, 7, 12), ("2024-01-03", 1, 1, 2)]
    points = {(str(r["date"]), r["loc"], r["count"]): r["times"] for r in report_points(reports).collect()}
    assert set(points) == {("2024-01-02", "الوادي", 5), ("2024-01-03", "الوادي", 1)}


def test_gazetteer_is_read_once(spark, tmp_path):
    """Documents come from a staged copy, not from the gazetteer's own plan."""
    raw, places = tmp_path / "raw", str(tmp_path / "places")
    raw.mkdir()
    dump(raw, "2024-01-02", [ALERT] * 3)
    named = [(f"قرية{k}", 1.0, 1.0, 1) for k in range(600)]  # too many to be compiled
    spark.createDataFrame([*named, ("الوادي", 33.0, 35.0, 0), ("الوادي", 33.0, 35.0, 0), (None, 1.0, 1.0, 1)], "name string, lat double, lng double, priority int").write.parquet(places)
    documents = ingest_documents(spark, str(raw), spark.read.parquet(places), part_size=3)
    assert not [f for f in documents.inputFiles() if "/places/" in f]
    assert [(p["loc"], p["count"]) for d in documents.collect() for p in d["sirenPoints"]] == [("الوادي", 3)]


def test_texts_with_and_without_escapes(spark, tmp_path):
    texts = ["plain", 'a "quote"', "back\\slash", "two\nlines", "tab\there", "a\u2028b and \u0007", "12 رمضان 1445 هـ", "12 رمضان 1445"]
    dump(tmp_path, "2024-01-02", texts)
    records = read_day_records(spark, str(tmp_path))
    found = parse_record_header(records.select(F.regexp_replace("record", r"^ID:\s*", "").alias("record")))
    rows = found.select("id", "text", "views", "reply_to", lunar_date(F.col("text")).alias("hijri")).orderBy("id").collect()
    assert [r["text"] for r in rows] == texts and {(r["views"], r["reply_to"]) for r in rows} == {(3, None)}
    assert [r["hijri"] for r in rows] == [None] * 6 + ["١٢ رمضان ١٤٤٥ هـ.", None]
