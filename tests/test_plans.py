"""Sources, sinks, search, places, validation and plans."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators import counts as K
from newsloom.operators import index as N
from newsloom.operators import places as P
from newsloom.plans import dashboard, facets, months, quality, search
from newsloom.plans.statistics import range_statistics
from newsloom.queries.base import KINDS, events
from newsloom.schemas import CATEGORIES, REPORT
from newsloom.sinks.dumps import format_record
from newsloom.sinks.reports import publish_days, publish_run, write_day_documents, write_event_tables, write_repaired, write_run
from newsloom.sources import dumps as source
from newsloom.sources.reports import quarantine, read_manifest, read_published, read_reports, read_reports_lenient, scan_date_range, to_events, to_report_rows
from newsloom.streaming.dumps import ingest_new_dumps

DAY = dt.date(2024, 1, 2)


# -- dumps -----------------------------------------------------------------------------


def dump(tmp_path, name, body, wrapped=True):
    path = tmp_path / name
    path.write_text(json.dumps({"result": body}) if wrapped else body, encoding="utf-8")
    return str(path)


LINE = "ID: {} | قناة | Date: {} | views:5, forwards:1, reactions:2 | Message: {}"


def test_dump_cases(spark, tmp_path):
    body = "\n".join([
        LINE.format(1, "2024-01-02 05:06:07+00:00", "سطر\nID: ليس رقما\nتتمة"),
        LINE.format(2, "2024-01-02 05:06:07-04:00", "offset"),
        LINE.format(3, "2024-01-03 23:59:00+00:00", "a\\nb"),
        LINE.format(4, "2024-01-03 23:59:00+00:00", "[Media/No text]"),
        "ID: 5 | قناة | no date | x | Message: lost",
        LINE.format(6, "2024-02-01 00:00:01+00:00", "reply").replace(" | views", " | reply to 77 | views"),
    ])
    for wrapped in (True, False):
        path = dump(tmp_path, f"d{wrapped}.json", body, wrapped)
        rows = {r["id"]: r for r in source.read_messages(spark, path).collect()}
        assert sorted(rows) == [1, 3, 6]
        assert rows[1]["text"] == "سطر" and rows[3]["text"] == "a\nb" and rows[6]["reply_to"] == 77
        assert (rows[1]["time"], rows[1]["views"], rows[1]["reactions"], rows[1]["sender"]) == ("05:06", 5, 2, "قناة")
        days = source.split_by_day(source.read_dump(spark, path)).groupBy("date").count().collect()
        assert {str(r["date"]): r["count"] for r in days} == {"2024-01-02": 2, "2024-01-03": 2, "2024-02-01": 1}
        assert source.count_raw_records(source.read_dump(spark, path)).first()["records"] == 7
    split = source.parse_record_header(source.read_text_records(spark, str(tmp_path / "dFalse.json")))
    assert sorted(r["id"] for r in split.collect()) == [1, 3, 6]


def test_format_and_parse_round_trip(spark):
    rows = events(spark, "/root/testdata/sf0.001")
    line = format_record(F.col("id"), F.lit(""), F.col("ts"), F.lit(None).cast("string"), views=F.col("user_id"))
    first = rows.orderBy("id").select(line).first()[0]
    assert first == "ID: 0 | Unknown | Date: 2024-01-01 00:09:58+00:00 | views:13 | Message: [Media/No text]"


def test_stream_takes_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    dump(folder, "a.json", LINE.format(1, "2024-01-02 05:06:07+00:00", "القناة 12 خبر"))
    for added in (1, 1, 2):
        if added == 2:
            dump(folder, "b.json", LINE.format(9, "2024-01-04 05:06:07+00:00", "صفارات الإنذار في الوادي"))
        ingest_new_dumps(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).select("id", "category").collect()
        assert len(got) == added
    assert {r["id"]: r["category"] for r in got} == {1: "enemy", 9: "sirens"}


# -- reports ---------------------------------------------------------------------------


def report(**changes):
    doc = {
        "date": "2024-01-02", "dayAr": "الثلاثاء", "dateAr": "٢ كانون الثاني ٢٠٢٤", "hijri": "",
        "stats": {c: 0 for c in CATEGORIES} | {"bayanat": 3, "sirens": 1},
        "bayanat": [
            {"num": n, "postTime": "05:00", "opTime": "", "target": "تل", "weapon": "رمح", "badge": "", "tags": ["k:v"], "bayan_type": "offensive", "fullText": "نص"}
            for n in (1, 2, 3)
        ],
        "sirens": [{"time": "07:00", "location": "بلدة الوادي", "fullText": "نص"}],
        "sirenPoints": [{"lat": 1.0, "lng": 0.0, "loc": "الوادي", "times": ["07:00"], "count": 1}],
        "enemy": [], "iran": [], "videos": [], "allies": [],
    }
    doc.update(changes)
    return {k: v for k, v in doc.items() if v is not ...}


def write(tmp_path, docs):
    for day, doc in docs.items():
        text = doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False)
        (tmp_path / f"{day}.json").write_text(text, encoding="utf-8")
    return str(tmp_path)


@pytest.fixture
def folder(tmp_path):
    good = report()
    bad_items = [dict(b) for b in good["bayanat"]]
    bad_items[0] |= {"num": 5, "target": "", "fullText": ""}
    bad_items[1] |= {"num": 5}
    bad_items[2] |= {"num": None}
    return write(tmp_path, {
        "2024-01-02": good,
        "2024-01-03": report(date="2024-01-09", dayAr="x", dateAr="", stats={"b": 9, "s": 1, "e": 2}, bayanat=bad_items, sirenPoints=[], enemy=...),
        "2024-01-04": "{broken",
        "2024-01-05": report(date="2024-01-05", dayAr="", dateAr="", sirenPoints=[{"lat": None, "lng": 0.0, "loc": "", "times": [], "count": 0}],
                             sirens=[{"time": "", "location": "", "fullText": ""}], allies=[{"flag": "", "time": "", "summary": "", "fullText": ""}]),
        "notes": {"x": 1},
    })


def test_validation_messages(spark, folder):
    issues = quality.report_issues(read_reports(spark, folder)).collect()
    got = {}
    for i in issues:
        got.setdefault(i["date"], set()).add((i["category"], i["severity"], i["message"]))
    assert "2024-01-02" not in got
    assert got["2024-01-04"] == {("parse", "error", "Cannot parse file")}
    assert got["2024-01-03"] == {
        ("date", "error", "date field '2024-01-09' != filename '2024-01-03'"),
        ("dayAr", "warn", "dayAr 'x' should be 'الأربعاء'"),
        ("stats", "error", "stats.bayanat=9 but actual array length=3"),
        ("stats", "error", "stats.enemy=2 but actual array length=0"),
        ("stats", "warn", "Missing stats.iran (actual: 0)"), ("stats", "warn", "Missing stats.videos (actual: 0)"),
        ("stats", "warn", "Missing stats.allies (actual: 0)"),
        ("bayan_num", "error", "Duplicate bayan numbers: [5]"),
        ("bayan_num", "warn", "Missing bayan numbers in sequence: [1, 2, 3, 4]"),
        ("bayan_field", "warn", "Bayan #5 missing both target and fullText"),
        ("bayan_field", "warn", "Bayan at index 2 missing 'num' field"),
        ("siren_points", "warn", "Has 1 sirens but no sirenPoints (0 geocodable from known locations)"),
        ("missing_array", "error", "stats.enemy=2 but 'enemy' array is missing entirely"),
    }
    assert {m for _, _, m in got["2024-01-05"]} >= {
        "sirenPoint[0] missing lat/lng", "sirenPoint[0] missing 'loc' name", "sirenPoint[0] count is 0",
        "Siren[0] missing location and fullText", "Siren[0] missing time", "Ally[0] missing summary and fullText", "Ally[0] missing flag (country)",
    }


def test_known_places_make_missing_points_an_error(spark, folder):
    known = quality.known_places(["الوادي", "جبل"])
    issues = quality.report_issues(read_reports(spark, folder), known).where("category = 'siren_points' and date = '2024-01-03'")
    assert [i["message"] for i in issues.collect()] == ["Has 1 sirens but no sirenPoints (1 geocodable)"]


def test_changed_days_are_published_alone(spark, tmp_path):
    """Repair of a published archive: equal to the repair of all, other days keep their
    run; a run without a manifest and half a manifest leave the old state."""
    def day(k, numbers, **more):
        named = dt.date(2024, 1, k).isoformat()
        items = [{"num": n, "postTime": t, "fullText": "x" * 500, "badge": ""} for n, t in numbers]
        return {"date": named, "file_date": named, "hijri": "", "bayanat": items, **{c: [] for c in REPORT.fieldNames() if c in (*CATEGORIES[1:], "sirenPoints", "summaries")}, **more}

    days = [day(2, [(1, "08:00"), (2, "12:00"), (3, "21:00")]), day(3, [(6, "08:00"), (7, "12:00"), (8, "20:00"), (1, "22:50"), (2, "23:10")]), day(4, [(3, "09:00"), (4, "15:00")]),
            day(5, [(1, "10:00")]), day(6, [(1, "10:00")], sirens=[{"time": "05:00", "location": "الوادي"}])]
    schema = T.StructType([*REPORT.fields, T.StructField("file_date", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("first_position", T.LongType())])
    docs = spark.createDataFrame([{"part": 0, "first_position": 0, **d} for d in days], schema)
    root = str(tmp_path / "archive")
    whole = quality.repair_documents(docs)
    wrong = whole.withColumn("dayAr", F.when(F.col("date") == "2024-01-05", "x").otherwise(F.col("dayAr")))
    with pytest.raises(ValueError):
        read_published(spark, root)
    publish_days(wrong.drop("file_date"), root)
    first = read_manifest(spark, root)[1].first()["run"]

    def state():
        return sorted((r["date"], r["dayAr"], [b["num"] for b in r["bayanat"]], r["stats"]["bayanat"], r["run"] == first) for r in read_published(spark, root).collect())

    old = state()
    places = spark.createDataFrame([("الوادي", 33.0, 35.0, 0)], "name string, lat double, lng double, priority int")
    fixed, changed = quality.repair_changed(read_published(spark, root), places)
    assert sorted(r["day"].isoformat() for r in changed.collect()) == ["2024-01-03", "2024-01-04", "2024-01-05", "2024-01-06"]
    run = write_run(fixed, root)
    assert state() == old
    spark.createDataFrame([("2024-01-02", run, 5)], "day string, run string, days bigint").write.parquet(f"{root}/manifest/number=2")
    assert state() == old
    publish_run(spark, root, run)
    assert read_manifest(spark, root)[0] == 2
    new = state()
    assert [r[0] for r in new if r[4]] == ["2024-01-02"]
    want = quality.repair_archive(docs, places)
    assert [r[:4] for r in new] == sorted((r["date"], r["dayAr"], [b["num"] for b in r["bayanat"]], r["stats"]["bayanat"]) for r in want.collect())
    assert [r[2] for r in new[1:3]] == [[6, 7, 8], [1, 2, 3, 4]]
    again, none = quality.repair_changed(read_published(spark, root), places)
    assert none.count() == 0 and again.count() == 0
    publish_days(again, root)
    assert state() == new


def test_repair_then_validate(spark, folder, tmp_path):
    reports = read_reports(spark, folder).where("_corrupt_record is null")
    fixed = quality.repair_documents(reports)
    left = {i["category"] for i in quality.report_issues(fixed).collect()}
    assert not left & {"date", "dayAr", "dateAr", "stats", "missing_array"}
    target = str(tmp_path / "fixed")
    write_repaired(fixed.drop("_corrupt_record"), target, dry_run=True)
    assert not (tmp_path / "fixed").exists()
    write_repaired(fixed.drop("_corrupt_record"), target)
    again = spark.read.schema(REPORT).json(target)
    assert again.where("date = '2024-01-03'").first()["stats"]["bayanat"] == 3


def test_missing_points_are_found(spark, folder):
    reports = read_reports(spark, folder)
    from newsloom.sources.reports import report_points

    gaz = spark.createDataFrame([("الوادي", 1.0, 2.0, 0)], "name string, lat double, lng double, priority int")
    alerts = to_events(reports.withColumn("date", F.col("file_date"))).where("category = 'sirens'").drop("lat", "lng")
    points = report_points(reports.withColumn("date", F.col("file_date")))
    found = quality.missing_points(alerts, points, gaz).collect()
    assert [(str(r["date"]), r["place"], r["lng"]) for r in found] == [("2024-01-03", "الوادي", 2.0)]


def test_events_reports_and_lenient_dates(spark, folder):
    rows = to_events(read_reports(spark, folder).where("file_date = '2024-01-02'")).orderBy("id").collect()
    assert [(r["category"], r["src_idx"], r["title"]) for r in rows] == [("bayanat", 0, "تل"), ("bayanat", 1, "تل"), ("bayanat", 2, "تل"), ("sirens", 0, "بلدة الوادي")]
    counted = {str(r["date"]): r["total"] for r in to_report_rows(read_reports(spark, folder), count_arrays=True).where("date is not null").collect()}
    assert counted["2024-01-02"] == 4
    lenient = [r["date"] for r in read_reports_lenient(spark, folder).collect()]
    assert sorted(lenient) == ["2024-01-02", "2024-01-04", "2024-01-05", "2024-01-09"]


def test_tables_are_written_and_pruned(spark, folder, tmp_path):
    reports = read_reports(spark, folder).where("file_date in ('2024-01-02', '2024-01-05')")
    write_event_tables(to_events(reports), to_report_rows(reports), str(tmp_path / "db"))
    stored = spark.read.parquet(str(tmp_path / "db/events"))
    one = stored.where(F.col("date") == F.lit(DAY))
    assert one.count() == 4
    assert "PartitionFilters: [isnotnull(date" in one._jdf.queryExecution().executedPlan().toString()
    write_day_documents(reports.select(*REPORT.fieldNames()), str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs/day=2024-01-02")).count() == 1


# -- search ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def archive_rows(spark):
    texts = [
        (1, DAY, "05:00", "قصف المدينة", "foo-bar baz"), (2, DAY, "06:00", "المدينه الثانية", "Foo qux"),
        (3, DAY + dt.timedelta(days=1), "07:00", "نهر", "barfoo"), (4, DAY + dt.timedelta(days=2), None, "جبل", "100% a_b"),
    ]
    return spark.createDataFrame(
        [(i, d, "bayanat", h, a, b, None, None) for i, d, h, a, b in texts],
        "id long, date date, category string, time string, title string, full_text string, location string, subtitle string",
    )


def ids(frame):
    return [r["id"] for r in frame.collect()]


def test_terms_and_fallback(archive_rows):
    assert sorted(ids(N.match_terms(archive_rows, ["المدين"]))) == [1, 2]
    assert sorted(ids(N.match_terms(archive_rows, ["foo-b"]))) == [1]
    assert ids(search.query_events(archive_rows, ["foo"])) == [2, 1]
    assert ids(search.query_events(archive_rows, ["rfoo"])) == [3]
    assert ids(search.query_events(archive_rows, ["%"])) == [4]
    assert ids(search.query_events(archive_rows, ["AND"])) == []
    assert N.search_terms(['"a*b"', "NOT", "x:y"]) == ["ab", "xy"]


def test_index_gives_the_same_rows(spark, archive_rows, tmp_path):
    N.write_postings(N.build_postings(archive_rows), str(tmp_path / "idx"), 3)
    postings = N.read_postings(spark, str(tmp_path / "idx"))
    for terms in (["foo"], ["المدين", "ba"], ["foo-b"], ["zzz"], ["foo bar"]):
        assert sorted(ids(N.match_terms_indexed(archive_rows, postings, terms))) == sorted(ids(N.match_terms(archive_rows, terms))), terms
    plan = N.lookup(postings, ["foo"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,foo)" in plan


def test_search_orders_and_dates(archive_rows):
    assert ids(search.search(archive_rows, "2024-01-02", DAY)) == [1, 2]
    assert ids(search.search(archive_rows, "yesterday foo", DAY + dt.timedelta(days=1))) == [2, 1]
    assert ids(search.search(archive_rows, "river", DAY, {"river": "نهر"})) == [3]
    assert ids(search.search(archive_rows, "kiv", DAY)) == [3]  # typed on the other layout
    assert ids(search.search(archive_rows, "  ", DAY)) == []


# -- places ----------------------------------------------------------------------------


def test_both_geocoders_agree_with_a_scan(spark):
    import random

    rnd = random.Random(5)
    word = lambda a, b: "".join(rnd.choice("ابتث") for _ in range(rnd.randint(a, b)))
    names = [(word(2, 5), float(i), -float(i), i) for i in range(40)]
    texts = [(i, word(1, 14)) for i in range(300)]
    gaz = spark.createDataFrame(names, "name string, lat double, lng double, priority int")
    rows = spark.createDataFrame(texts, "id long, text string")
    for mode in ("longest", "first"):
        want = {}
        for i, text in texts:
            order = {}
            for n, *_, p in names:  # equal names: later coordinates, earlier place in the order
                order.setdefault(n, p)
            hits = [n for n in order if n in text]
            if hits:
                best = min(hits, key=lambda n: (-len(n) if mode == "longest" else 0, order[n]))
                want[i] = (best, max(float(p) for n, _, _, p in names if n == best))
        for limit in (500, 0):
            found = P.geocode(rows, "text", gaz, mode, compile_limit=limit)
            assert {r["id"]: (r["place"], r["lat"]) for r in found.collect()} == want, (mode, limit)


# -- plans -----------------------------------------------------------------------------


def test_dashboard_sets(spark):
    rows = events(spark, "/root/testdata/sf0.001").withColumn("category", F.element_at(F.create_map(*[F.lit(x) for k, c in zip(KINDS, CATEGORIES) for x in (k, c)]), F.col("category")))
    sets = dashboard.dashboard(rows, dt.date(2024, 1, 5), dt.date(2024, 1, 12), [], "weekly", "nonsense")
    total = sum(r["n"] for r in sets["kpis"].collect())
    assert total == rows.where("date between '2024-01-05' and '2024-01-12'").count()
    assert sum(sum(r[c] for c in CATEGORIES) for r in sets["series"].collect()) == total
    assert [r["category"] for r in sets["kpis"].orderBy("ordinal").collect()] == list(CATEGORIES)
    table = sets["table"].collect()
    assert [r["total"] for r in table] == sorted((r["total"] for r in table), reverse=True)


def test_label_counts_come_largest_first(spark):
    labels = [f"{k:02}" for k in range(30) for _ in range(k % 4 + 1)] + [None] * 9
    rows = spark.createDataFrame([(x,) for x in labels], "label string").repartition(4)
    found = [tuple(r) for r in K.type_dashboard(rows, F.col("label")).collect()]
    assert found == sorted(((f"{k:02}", k % 4 + 1) for k in range(30)), key=lambda r: (-r[1], r[0]))
    assert [tuple(r) for r in K.type_dashboard(rows, F.col("label"), 2).collect()] == found[:2]


def test_dashboard_reads_events_once(spark, tmp_path):
    """Every panel equals its own operator over the rows, and no plan of a panel has the events in it."""
    rows = [(DAY + dt.timedelta(days=k % 9), CATEGORIES[k % 5], ("05:10", "23:59", "", None, "7:1")[k % 5], ("x", "", None, "y")[k % 4]) for k in range(200)]
    spark.createDataFrame(rows, "date date, category string, time string, title string").write.parquet(str(tmp_path / "events"))
    read = spark.read.parquet(str(tmp_path / "events"))
    sets = dashboard.dashboard(read, grouping="monthly", page_size=4)
    assert not [n for n, s in sets.items() if str(tmp_path) in " ".join(s.inputFiles())]
    K = dashboard.K
    plain = {
        "kpis": K.kpi_counts(read), "series": K.time_series(read, "monthly"), "heatmap": K.hour_dow_heatmap(read), "heatmap_margins": K.heatmap_margins(read),
        "top_values": K.top_values(read, "title", 10, "bayanat"), "pages": dashboard.page_count(read, 4),
        "table": dashboard.page(K.daily_pivot(read, CATEGORIES[:5]), "total", True, 1, 4),
    }
    assert sorted(plain) == sorted(sets)
    for name, expected in plain.items():
        assert sorted(map(str, sets[name].select(*expected.columns).collect())) == sorted(map(str, expected.collect())), name
    empty = dashboard.dashboard(read.where("false"))
    assert [r["n"] for r in empty["kpis"].collect()] == [0] * len(CATEGORIES) and empty["pages"].first()["pages"] == 1


def test_set_aside_documents(spark, tmp_path):
    """Broken, undated, misnamed and good files: two sides, nothing lost."""
    texts = {
        "2024-01-02": '{"date": "2024-01-02", "sirens": [{"time": "05:00"}]}', "2024-01-03": '{"date": "2024-01-03", "sirens": [', "2024-01-04": '{"sirens": []}',
        "2024-01-05": '{"date": "2024-01-06"}', "20240107": '{"hijri": "x"}', "2024-01-08": "", "2024-01-09": "[1, 2",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    good, aside = quarantine(read_reports_lenient(spark, str(tmp_path)))
    assert sorted(r["date"] for r in good.collect()) == ["2024-01-02", "2024-01-04"]
    faults = {r["file_date"]: r["fault"] for r in aside.collect()}
    assert faults == {"2024-01-03": "unreadable", "2024-01-05": "misnamed", "20240107": "undated", "2024-01-09": "unreadable"}
    assert {r["file_date"]: r["_corrupt_record"] for r in aside.collect()}["2024-01-03"] == texts["2024-01-03"]
    assert to_events(good).count() == 1


def test_only_folders_of_the_range_are_read(spark, tmp_path):
    rows = events(spark, "/root/testdata/sf0.001")
    write_event_tables(rows, rows.groupBy("date").count(), str(tmp_path))
    range_ = scan_date_range(spark.read.parquet(str(tmp_path / "events")), DAY, DAY + dt.timedelta(days=2))
    files = range_._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert range_.count() > 0
    assert len({f.split("date=")[1][:10] for f in range_.select("id", F.input_file_name().alias("f")).toPandas()["f"]}) == 3
    assert "PartitionFilters: [isnotnull(date" in files.toString()


def test_empty_export_has_six_sets(spark, tmp_path):
    rows = to_events(spark.createDataFrame([], REPORT))
    dashboard.export_report(rows, str(tmp_path), DAY, DAY)
    names = sorted(p.name for p in (tmp_path / f"{DAY}_{DAY}").iterdir())
    assert names == ["events_over_time", "hourly_density", "kpis", "most_active_days", "raw_data", "top_targets"]


def test_statistics_document(spark):
    schema = "date date, bayan_type string, target string, weapon string, badge string, full_text string, strikes array<struct<opTime:string,target:string,weapon:string>>"
    rows = [
        (DAY, "statement", "", "", "", "مروحية", None),
        (DAY, "defensive", "بلدة الوردة", "رشاش", "", "تصدى لمحاولة التقدم، دبابة ودبابة و3 جنود", None),
        (DAY, "list_strikes", "", "صلية صاروخية", "", "", [("", "قاعدة النسر", ""), ("", "بلدة الوردة", "صاروخ موجه")]),
        (DAY, "list_strikes", "موقع النجمة", "", "", "", []),
        (DAY, "offensive", "شيء", "صاروخ أرض جو", "", "", [("", "x", "y")]),
    ]
    days = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(days=1),)], "date date")
    doc = range_statistics(spark.createDataFrame(rows, schema), days, ["الوردة"]).first().asDict(True)
    assert doc["totals"] | {"max_single_day": None} == {
        "operations": 6, "operations_distinct": 5, "offensive_strikes": 3, "defensive_ops": 1, "counter_advance": 2, "counter_landing": 0,
        "statements_excluded": 1, "daily_avg": 6.0, "max_single_day": None,
    }
    assert doc["period"]["days_scanned"] == 2 and doc["period"]["active_days"] == 1
    assert doc["targets"] == {"تصدي_لعملية_تقدم": 2, "قواعد_عسكرية": 1, "مواقع_حدودية_ومستحدثة": 1, "طائرات_ومسيّرات": 1}
    assert doc["losses"]["دبابات"] == 2 and doc["losses"]["قتيل_وجريح"] == 3 and "مروحيّة" not in doc["losses"]


def test_month_summary(spark, archive):
    reports = read_reports(spark, f"{archive}/data")
    month_rows, points = months.month_summary(to_report_rows(reports), to_events(reports))
    rows = month_rows.orderBy("month").collect()
    assert sum(r["days"] for r in rows) == 134 and sum(r["total"] for r in rows) == 825
    assert rows[0]["previous"] is None and rows[0]["trend"] == "none" and rows[-1]["next"] is None
    assert all(r["brief"] for r in rows)
    assert points.groupBy("month").count().agg(F.max("count")).first()[0] <= 4


def test_facets_of_the_archive(spark, archive):
    reports = read_reports(spark, f"{archive}/data")
    from newsloom.sources.reports import report_points

    sets = facets.facets(to_events(reports), report_points(reports))
    counts = {(r["facet"], r["value"]): r["n"] for r in sets["facet_counts"].collect()}
    assert counts[("badges", "communique")] == 9 and not any(f == "targets" for f, _ in counts)
    assert sum(n for (f, _), n in counts.items() if f == "flags") == 201


def test_no_row_udfs_and_no_products(spark):
    from newsloom.queries import catalogue

    queries, oracles = catalogue()
    assert set(oracles) <= set(queries)
    for name, make in queries.items():
        plan = make(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "PythonUDF" not in plan and "EvalPython" not in plan, name


def test_nearest_across_cells_and_the_date_line(spark):
    import math
    import random

    from newsloom.operators.places import nearest_within

    rng = random.Random(6)
    near = lambda lat, lng: [("a", lat + rng.uniform(-0.3, 0.3), (lng + rng.uniform(-0.3, 0.3) + 180) % 360 - 180) for _ in range(40)]
    spots = [(0.0, 0.0), (33.2, 35.4), (-60.1, 179.95), (89.6, -20.0), (45.0, -180.0)]
    places = [p for s in spots for p in near(*s)]
    candidates = [(*p, k) for k, p in enumerate(p for s in spots for p in near(*s))]

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    expected = {}
    for _, lat, lng in places:
        best = min((km(lat, lng, c[1], c[2]), c[3]) for c in candidates)
        if best[0] <= 20:
            expected[lat, lng] = best[1]
    got = nearest_within(
        spark.createDataFrame(places, "name string, lat double, lng double"),
        spark.createDataFrame(candidates, "name string, c_lat double, c_lng double, candidate_id int"))
    assert {(r["lat"], r["lng"]): r["candidate_id"] for r in got.collect()} == expected


def test_geocoding_is_the_same_for_missing_and_repeated_keys(spark):
    gaz = spark.createDataFrame([("Vale", 1.0, 2.0, 0), ("North Vale", 3.0, 4.0, 1)], "name string, lat double, lng double, priority int")
    rows = spark.createDataFrame([(None, "at North Vale"), (1, "in Vale"), (1, "North Vale"), (2, None), (3, "none")], "id int, text string")
    both = [sorted(map(str, P.geocode(rows, "text", gaz, compile_limit=n).select("id", "text", "place").collect())) for n in (0, 100)]
    assert both[0] == both[1] and len(both[0]) == 3
