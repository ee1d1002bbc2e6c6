"""Dump files of every form, cut inside the file and read back whole."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom.sinks.dumps import day_dumps, write_day_dumps
from newsloom.sources import dumps as source
from newsloom.streaming.dumps import ingest_new_dumps, message_stream

LINE = "ID: {} | channel | Date: 2024-01-02 05:{:02}:00+00:00 | views:3 | Message: {}"
BODIES = ["سطر {}", "two\nlines {}", 'a "quoted" word {}', "back\\slash {}", "literal\\nbreak {}", "UUID:{} PID: 4", "tab\t{}", "{}" + "long " * 60, "é {{\"result\": 1}} {}", "x\nID: no number {}"]


def records(n, bodies=BODIES):
    return [LINE.format(k, k % 60, bodies[k % len(bodies)].format(k)) for k in range(n)]


def plain(text):
    """Messages of one document, by id."""
    out = {}
    for part in re.split(r"(?:^|\n)ID:\s*", text):
        m = re.match(r"(\d+)\s*\|[^|]*\|\s*Date:\s*(\d{4}-\d{2}-\d{2})\s+\d{2}:\d{2}:\d{2}\+\d{2}:\d{2}\s*\|.*?\|\s*Message:\s*(.*)", part.strip(), re.DOTALL)
        if m:
            out[int(m[1])] = m[3].strip().replace("\\n", "\n")
    return out


def documents(rows, size):
    return ["\n".join(rows[i : i + size]) for i in range(0, len(rows), size)]


FORMS = {
    "bare": lambda rows: "\n".join(rows),
    "json": lambda rows: json.dumps({"result": "\n".join(rows)}, ensure_ascii=False),
    "escaped": lambda rows: json.dumps({"day": "d", "result": "\n".join(rows), "n": [1, {"x": "}"}]}),
    "pretty": lambda rows: json.dumps({"result": "\n".join(rows)}, ensure_ascii=False, indent=2),
    "lines": lambda rows: "\n".join(json.dumps({"result": d}, ensure_ascii=False) for d in documents(rows, 7)) + "\n",
    "one": lambda rows: "\n".join(json.dumps({"result": d}) for d in documents(rows, 1)),
}


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("form", ["bare", "json"])
def test_records_dealt_by_size(spark, tmp_path, monkeypatch, form):
    """More bytes of dumps give more tasks of text work, not longer ones."""
    from newsloom.operators import scale

    monkeypatch.setattr(scale, "TASK_BYTES", 2_000)
    for n in (300, 900):
        path = tmp_path / f"{n}.json"
        path.write_text(FORMS[form](records(n)), encoding="utf-8")
        found = source.read_day_records(spark, str(path))
        sizes = [k for (k,) in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
        # At most a few times the records of 2,000 bytes in a task.
        assert sum(sizes) >= 0.8 * n and len(sizes) >= path.stat().st_size // 4_000 and max(sizes) <= 40


@pytest.mark.parametrize("form", sorted(FORMS))
def test_one_file_in_many_tasks(spark, tmp_path, small_splits, form):
    rows = records(300)
    (tmp_path / "a.json").write_text(FORMS[form](rows), encoding="utf-8")
    path = str(tmp_path / "a.json")
    assert source.read_pieces(spark, path).rdd.getNumPartitions() > 5
    found = source.read_messages(spark, path).collect()
    want = plain("\n".join(rows))
    assert len(found) == len(want) == 300 and {r["id"]: r["text"] for r in found} == want
    assert source.count_file_records(spark, path).first()["records"] == 300 + 30
    assert source.read_day_records(spark, path).count() == 300


def test_all_forms_in_one_folder(spark, tmp_path):
    draw = random.Random(1)
    for k, form in enumerate(sorted(FORMS)):
        (tmp_path / f"{form}.json").write_text("intro\n" * (form == "bare") + FORMS[form](records(20 + k)), encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "other.json").write_text(json.dumps({"rows": [draw.random()]}))
    want = {f"{form}.json": 20 + k for k, form in enumerate(sorted(FORMS))}
    got = source.read_day_records(spark, str(tmp_path)).groupBy("file").count().collect()
    assert {r["file"].rsplit("/", 1)[1]: r["count"] for r in got} == want
    assert source.read_dump(spark, str(tmp_path / "lines.json")).count() > 1


def test_literal_break_before_id(spark, tmp_path):
    """A backslash and an n of the text itself in front of ``ID:`` are no record start."""
    rows = records(4) + [LINE.format(4, 4, "text\\nID: 77 | channel | Date: 2024-01-02 05:05:05+00:00 | x | Message: inside")]
    for form in ("json", "lines", "bare"):
        path = str(tmp_path / f"{form}.json")
        (tmp_path / f"{form}.json").write_text(FORMS[form](rows), encoding="utf-8")
        assert {r["id"]: r["text"] for r in source.read_messages(spark, path).collect()} == plain("\n".join(rows))
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in source.dump_kinds(spark, str(tmp_path)).collect()}
    assert kinds == {"json.json": "whole", "lines.json": "whole", "bare.json": "bare"}


def test_written_parts_come_back(spark, tmp_path):
    rows = [(k, dt.date(2024, 1, 2 + k % 2), r) for k, r in enumerate(records(100, BODIES[:9]))]
    written = day_dumps(spark.createDataFrame(rows, "id long, date date, record string"), part_size=7, width=16)
    write_day_dumps(written.coalesce(1), str(tmp_path / "raw"))
    found = source.read_messages(spark, f"{tmp_path}/raw/*/*.json").collect()
    assert sorted(r["id"] for r in found) == list(range(100))


def test_stream_reads_every_document_once(spark, tmp_path):
    """Two runs with one checkpoint: the files of each are read once, all documents of them."""
    raw, target, state = (str(tmp_path / x) for x in ("raw", "target", "state"))
    (tmp_path / "raw").mkdir()
    news = [LINE.format(k, k, f"القناة 12 خبر {k}") for k in range(40)]
    for run, part in enumerate((news[:25], news[25:])):
        (tmp_path / "raw" / f"{run}.json").write_text(FORMS["lines"](part), encoding="utf-8")
        ingest_new_dumps(spark, raw, target, state).awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(target).select("id").collect()) == list(range((25, 40)[run]))
    assert message_stream(spark, raw).isStreaming
    batches = spark.read.parquet(target).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r["n"] for r in batches) == [15, 25]


def test_stream_drops_copies_of_earlier_batches(spark, tmp_path):
    """A video that came before is dropped later, whatever its number; one batch per
    file; a run without new files adds nothing."""
    raw, target, state = (str(tmp_path / x) for x in ("raw", "target", "state"))
    (tmp_path / "raw").mkdir()

    def line(number, day, text):
        return f"ID: {number} | channel | Date: 2024-01-{day:02} 05:07:00+00:00 | views:3 | Message: {text}"

    video = "بالفيديو | مشهد {} جودة عالية #فيديو"
    lots = [
        [line(7, 2, video.format("a")), line(8, 2, video.format("a")), line(9, 2, "القناة 12 خبر")],
        [line(1, 2, video.format("a")), line(2, 2, video.format("b")), line(3, 3, video.format("a")), line(4, 2, "القناة 12 خبر")],
        [line(5, 2, "القناة 12 خبر")], [line(6, 2, video.format("b"))],
    ]
    for k, lot in enumerate(lots):
        (tmp_path / "raw" / f"{k}.json").write_text(FORMS["json"](lot), encoding="utf-8")
        for _ in range(2):
            ingest_new_dumps(spark, raw, target, state, files_per_batch=1).awaitTermination()
    got = spark.read.parquet(target).select("id", "batch").collect()
    assert sorted((r["id"], r["batch"]) for r in got) == [(2, 1), (3, 1), (4, 1), (5, 2), (7, 0), (9, 0)]
