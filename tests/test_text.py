"""Text, extraction and date functions on small fixtures of our own."""

import datetime as dt

from pyspark.sql import functions as F

from newsloom.functions import classify as C
from newsloom.functions import dates as D
from newsloom.functions import extract as X
from newsloom.functions import text as T
from newsloom.functions import translit as L
from newsloom.operators.scale import pin


def values(spark, texts, *columns):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r)[1:] for r in rows]


t = F.col("t")


def test_normal_forms(spark):
    word = "أُمّـة‏ ١٢ ى"
    assert values(spark, [word, "", None], T.norm_match(t)) == ["امة 12ي", "", ""]
    assert values(spark, ["المدينةِ ٱلأولى ABC"], T.norm_index(t)) == ["المدينه الاولي abc"]
    assert values(spark, ["  قَولٌ؟! . "], T.norm_facet(t)) == ["قول"]
    once = values(spark, [word], T.norm_match(t))
    assert values(spark, once, T.norm_match(t)) == once


def test_noise_and_titles(spark):
    assert values(spark, ["‏", None, "x [Media/No text]", "text", " ﻿"], T.is_noise(t)) == [True, True, True, False, True]
    assert values(spark, ["a" * 90, "", "b"], T.display_title(t, F.lit("z"))) == ["a" * 80 + "...", "z", "b"]
    assert values(spark, ["#a قول #b_c آخر"], T.strip_hashtags(t)) == ["قول  آخر"]


def test_spans(spark):
    text = "ضُرِبت الْمدينة وأُخرى المدينه."
    got = values(spark, [text], T.match_spans(t, ["المدينة", "x"]))[0]
    assert [text[s["start"]:s["end"]] for s in got] == ["الْمدينة", "المدينه"]
    assert values(spark, ["abc"], T.match_spans(t, ["zz"])) == [[]]
    assert values(spark, ["a.b+ a.b"], T.match_spans(t, ["a.b"]))[0][1]["start"] == 5


def test_transliteration_and_aliases(spark):
    assert values(spark, ["hguv lfh B 7!"], L.keyboard_transliterate(t)) == ["العر مبا لآ 7!"]
    assert values(spark, ["Khan Shaqx ee"], L.phonetic_transliterate(t)) == ["خان شاقكس ي"]
    table = {"tank": "T", "anti tank": "A", "a.b": "R"}
    assert values(spark, ["Anti Tank tanks a.b axb"], L.resolve_aliases(t, table)) == ["A Ts R axb"]
    assert values(spark, ["tanks tank"], L.resolve_aliases(t, table, whole_words=True)) == ["tanks T"]


CASES = [
    ("raids today", ("single", "2024-10-10", "2024-10-10", "raids", "اليوم")),
    ("أخبار البارحة", ("single", "2024-10-09", "2024-10-09", "أخبار", "أمس")),
    ("3 days ago x", ("single", "2024-10-07", "2024-10-07", "x", "قبل 3 يوم")),
    ("1 week ago", ("range", "2024-10-03", "2024-10-10", "", "قبل 1 أسبوع")),
    ("منذ ٢ شهور", ("range", "2024-08-11", "2024-09-11", "", "قبل 2 شهر")),
    ("last month y", ("range", "2024-09-10", "2024-10-10", "y", "الشهر الماضي")),
    ("هذا الأسبوع", ("range", "2024-10-07", "2024-10-10", "", "هذا الأسبوع")),
    ("a 2024-02-29 b", ("single", "2024-02-29", "2024-02-29", "a b", "29 فبراير 2024")),
    ("2023-02-29", (None, None, None, "2023-02-29", None)),
    ("7.3.2024", ("single", "2024-03-07", "2024-03-07", "", "7 مارس 2024")),
    ("oct 7, 2024 news", ("single", "2024-10-07", "2024-10-07", "news", "7 أكتوبر 2024")),
    ("7 october 2024", ("single", "2024-10-07", "2024-10-07", "", "7 أكتوبر 2024")),
    ("feb 2024", ("range", "2024-02-01", "2024-02-29", "", "1 فبراير 2024 – 29 فبراير 2024")),
    ("٧ تشرين الأول ٢٠٢٤ خبر", ("single", "2024-10-07", "2024-10-07", "خبر", "7 أكتوبر 2024")),
    ("todays", (None, None, None, "todays", None)),
    ("plain words", (None, None, None, "plain words", None)),
]


def test_date_phrases(spark):
    frame = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(CASES)], "i int, t string")
    as_of = F.lit(dt.date(2024, 10, 10))
    rows = frame.withColumn("d", D.extract_date_range(t, as_of))
    for r in rows.collect():
        d = r["d"]
        got = (d["type"], d["start"] and str(d["start"]), d["end"] and str(d["end"]), d["remaining"], d["label"])
        assert got == CASES[r["i"]][1], CASES[r["i"]][0]


def test_calendar(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(1500)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", D.week_key(F.col("d")), D.dow_of(F.col("d"))).collect()
    assert all((r[1], r[2]) == (r[0].strftime("%Y-W%W"), (r[0].weekday() + 1) % 7) for r in rows)
    assert values(spark, ["04:59", "", "16:00", "12:30"], D.day_phase(t)) == ["fajr", "fajr", "masaa", "zuhr"]
    one = spark.range(1).select(
        D.localised_date(F.lit(dt.date(2026, 2, 4))), D.localised_day_name(F.lit(dt.date(2026, 2, 4))), D.month_ordinal(F.lit(dt.date(2024, 1, 1)))
    ).first()
    assert tuple(one) == ("٤ شباط ٢٠٢٦", "الأربعاء", 4)


HEAD = "بيان صادر عن المقاومة الإسلامية (٣)\n"


def fields(spark, texts):
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, t string")
    frame = pin(frame, n=T.norm_match(t), b=X.clean_body(t))
    frame = pin(frame, target=X.extract_target(F.col("b")))
    return frame.select(
        "i", "target", X.extract_weapon(F.col("n")).alias("weapon"), X.op_time(F.col("n")).alias("time"),
        X.statement_number(F.col("n")).alias("num"), X.parse_list_items(t, F.col("target"), F.col("n")).alias("items"),
        X.classify_type(F.col("n"), X.statement_number(F.col("n"))).alias("type"),
    ).orderBy("i").collect()


def test_statement_fields(spark):
    rows = fields(spark, [
        HEAD + "استهدف المجاهدون عند الساعة 9:05 من صباح اليوم الخميس تجمّعًا في محيط بلدة الوردة بالأسلحة الصاروخية.",
        HEAD + "تصدّى المجاهدون لطائرة حربيّة فجر اليوم بصاروخ أرض جو",
        HEAD + "قصف المجاهدون (ثكنة القمر) عند تقاطع النهر (الغربي، بصلية صاروخية",
        HEAD + "استهدفنا المستوطنات التي سبق التحذير لها",
        "كلام بلا شيء بصاروخ زلزال، وحققوا",
    ])
    # The aircraft pattern asks for a mark that the cleaned body no longer has.
    assert [r["target"] for r in rows] == ["الوردة", "", "النهر", "المستوطنات الحدودية", ""]
    assert [r["weapon"] for r in rows] == ["أسلحة صاروخية", "صاروخ أرض جوّ", "صلية صاروخية", "", "زلزال"]
    assert [r["time"] for r in rows] == ["09:05", "", "", "", ""]
    assert [r["num"] for r in rows] == [3, 3, 3, 3, 0]
    assert [r["type"] for r in rows] == ["offensive", "defensive", "offensive", "offensive", "statement"]


def test_list_forms(spark):
    rows = fields(spark, [
        HEAD + "استهدف المجاهدون موقع النجمة بصلية صاروخية على النحو الآتي:\n- 08:05 موقع القلعة بقذائف المدفعية.\n- الساعة 9.10 بصاروخ موجه.\n- 10:00 في تلة الريح\n#وسم\n- 11:00 خارج.",
        HEAD + "استهدف المجاهدون موقع النجمة وفق الآتي عند الساعة 08:15 تلة الريح بقذائف الهاون.\nوعند الساعة 9:20 بصاروخ موجه.",
        HEAD + "عند الساعة 7:30 قصفنا بالأسلحة الصاروخية على الشكل الآتي:\n• تلة الريح.\n• جبل الثلج بقذائف المدفعية.",
        HEAD + "بلا قائمة",
    ])
    items = [[tuple(i) for i in r["items"]] if r["items"] is not None else None for r in rows]
    assert items[0] == [
        ("08:05", "موقع القلعة", "قذائف مدفعية"), ("09:10", "موقع النجمة", "صاروخ موجّه"), ("10:00", "تلة الريح", "صلية صاروخية"),
    ]
    assert items[1] == [("08:15", "تلة الريح", "قذائف هاون"), ("09:20", "موقع النجمة", "صاروخ موجّه")]
    assert items[2] == [("07:30", "تلة الريح", "أسلحة صاروخية"), ("07:30", "جبل الثلج", "قذائف مدفعية")]
    assert items[3] is None


def test_list_rows_equal_the_arrays(spark):
    texts = [HEAD + "استهدفنا موقع النجمة على النحو الآتي:\n- 08:05 تلة الريح بقذائف المدفعية.\n- 09:00 بصاروخ موجه.", "كالآتي : - نهر. - بحر بسلاح الهندسة."]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, t string")
    frame = pin(frame, n=T.norm_match(t), target=X.extract_target(X.clean_body(t)))
    rows = X.list_item_rows(frame, "t", "target", "n").select("i", "item_no", "op_time", "item_target", "item_weapon")
    arrays = frame.select("i", F.posexplode(X.parse_list_items(t, F.col("target"), F.col("n"))).alias("item_no", "x")).select("i", "item_no", "x.*")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, arrays.collect()))


def test_buckets(spark):
    got = values(
        spark, ["قاعدة النسر", "قاعدة جوّية", "بلدة الوردة", "موقع النجمة", "", "مدينة البحر"],
        C.classify_target_type(t, F.lit(""), ["الوردة"], []),
    )
    assert got == ["قواعد_عسكرية", "أخرى", "تصدي_لعملية_تقدم", "مواقع_حدودية_ومستحدثة", "أخرى", "مدن_ومستوطنات"]
    assert values(spark, ["عملية إنزال ثم تقدّم", "تقدم", "قصف"], C.counter_attack_kind(t)) == ["landing", "advance", None]
    assert values(spark, ["صليات صاروخية!", "قنص", "x" * 51, "رمح.", None], C.canonical_weapon(t)) == ["صلية صاروخية", None, None, "رمح", None]


def test_cascade_takes_every_message_once(spark):
    texts = [HEAD, "صفارات الإنذار تدوي في الوادي", "حركة حماس: بيان صادر عن حزب الله", "صنعاء: طهران", "طهران", "القناة 12 بالفيديو", "بالفيديو", "خبر", "‏", "UKMTO"]
    frame = pin(spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, t string"), m=X.match_text(t))
    got = [r[0] for r in frame.orderBy("i").select(X.classify_route(t, F.col("m"))).collect()]
    assert got == ["bayanat", "sirens", "bayanat", "allies/اليمن", "iran", "enemy", "videos", "other", "noise", "enemy"]
    assert values(spark, ["#عاجل صفّارات الإنذار تدوي في الوادي\nالآن"], X.alert_location(t)) == ["في الوادي الآن"]


def test_spans_by_offset_map(spark):
    """The offset map against a plain walk, and the widened pattern against the map."""
    t = F.col("v")
    texts = ["أَلْمُقَاوَمَةُ x", "ab", "", "ٌab أب", "İab İAB", "a.b A.B", None, "قاومُّة" * 200]
    table = spark.createDataFrame([(x,) for x in texts], "v string")
    got = table.select(T.offset_map(t), T.norm_highlight(t)).collect()
    for text, (at, folded) in zip(texts, got):
        if text is None:
            assert at is None
            continue
        want = [i for i, ch in enumerate(text) for _ in range(len(ch.lower())) if ch not in T.MARKS_WIDE]
        assert at == want and len(folded) == len(want)
    spans = [r[0] for r in table.select(T.mapped_spans(t, ["ab", "المقاومة", "أب", "قاومة", "a.b", "q"])).collect()]
    cut = [[x[s["start"]:s["end"]] for s in found] for x, found in zip(texts, spans)]
    assert cut[:3] == [["أَلْمُقَاوَمَةُ"], ["ab"], []] and cut[3] == ["ab", "أب"] and cut[4] == ["ab", "AB"] and cut[5] == ["a.b", "A.B"]
    assert cut[6] == [] and cut[7] == ["قاومُّة"] * 200
    assert table.select(F.max(F.size(T.mapped_spans(t, ["q"])))).first()[0] == 0
    plain = table.where("v not like '%İ%'")
    terms = ["المقاومة", "ab", "قاومة"]
    assert plain.where(~T.mapped_spans(t, terms).eqNullSafe(T.match_spans(t, terms))).count() == 0


def test_patterns_run_only_where_their_words_stand(spark, monkeypatch):
    """Fields are the same whether patterns are held back or all run, and white
    space is trimmed as by the pattern."""
    import random
    import re

    from newsloom.functions import extract as E
    from newsloom.functions.text import norm_match, strip
    from newsloom.lexicon import extraction as L

    rng = random.Random(5)
    vocabulary = sorted(set(re.findall("[\u0600-\u06ff]+", " ".join([*L.TARGET_PATTERNS, *L.BODY_REMOVALS, *L.LOCATION_CLAUSES, *(p for p, _ in L.WEAPON_LABELS)]))))
    odd = [" ", "\n", ". ", ":", "\u00a0", "(", ")", "، ", " في ", " على ", " عند ", " من ", "12:30 ", "على النحو الآتي:", "\n- 01:20 ", " .\n", "#وسم "]
    texts = ["".join(rng.choice(vocabulary) + rng.choice(odd) if rng.random() < 0.5 else rng.choice(vocabulary) + " " for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, text string")

    def fields():
        body = E.clean_body(F.col("text"))
        normal = norm_match(F.col("text"))
        return rows.select(
            "id", E.extract_target(body).alias("target"), E.extract_target(F.col("text")).alias("raw"), E.clean_location(F.col("text")).alias("place"),
            E.extract_weapon(normal).alias("weapon"), E.parse_list_items(F.col("text"), F.lit("t"), normal).alias("items")).orderBy("id").collect()

    held_back = fields()
    assert set(L.PATTERN_WORDS) >= {*L.TARGET_PATTERNS, *L.BODY_REMOVALS, *L.LOCATION_CLAUSES, L.LIST_STOP}
    assert all(L.PATTERN_WORDS.get(p) for p in (*L.TARGET_PATTERNS, L.LIST_TAIL, L.LIST_MARKER))
    monkeypatch.setattr(L, "PATTERN_WORDS", {})
    monkeypatch.setattr(L, "WEAPON_WORDS", ("",))
    assert held_back == fields() and sum(bool(r["target"]) for r in held_back) > 100
    every = spark.range(1, 0xD800).select(F.concat(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"), F.lit("a ")).alias("t"))
    assert every.where(strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).isEmpty()
