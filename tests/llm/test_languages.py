import zlib
from collections import Counter

import pytest

from newsloom.llm import languages as L


def key(gram):
    code = 0
    for c in gram:
        code = (code << 21) | (1 if c == " " else ord(c))
    return code


def plain_ngrams(text):
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    if not letters.strip():
        return Counter()
    padded = " " + " ".join(letters.split(" ")).strip() + " "
    while "  " in padded:
        padded = padded.replace("  ", " ")
    grams = Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))
    del grams[" "]
    return grams


def top(grams, size):
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], key(x[0])))[:size]]


def remainder(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 3


def plain(rows, size):
    counts = {}
    for i, lang, text in rows:
        if lang is not None and remainder(i) != 1 and plain_ngrams(text):
            counts.setdefault(lang, Counter()).update(plain_ngrams(text))
    known = {lang: {g: k for k, g in enumerate(top(c, size))} for lang, c in sorted(counts.items())}
    out = []
    for i, _, text in rows:
        own = top(plain_ngrams(text), size)
        far = [(sum(abs(k - p[g]) if g in p else size for k, g in enumerate(own)), lang) for lang, p in known.items()]
        lang, score = ("und", 0.0) if not own or not far else (min(far)[1], 1 - min(far)[0] / (size * len(own)))
        out.append((i, remainder(i) == 1, lang, round(score, 9)))
    return sorted(out, key=str)


def got(docs, size):
    return sorted(((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in L.predict(docs, size).collect()), key=str)


def given(docs):
    return [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()]


@pytest.mark.parametrize("size", [30, L.SIZE])
def test_against_plain(small, size):
    assert got(small, size) == plain(given(small), size)


def test_odd_rows(spark, odd, monkeypatch):
    assert got(odd, 50) == plain(given(odd), 50)
    rows = [(i, f"l{i % 5}", "abcdefgh"[i % 5 :] * 3 + ("İß 漢字 ﬁ" if i == 7 else "")) for i in range(40)] + [(None, None, "xyz"), (3, "l1", None), (5, "l1", "12 !"), (77, "l9", None)]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, lang string, text string, rank long, distance double")
    whole = got(docs, 20)
    assert whole == plain(rows, 20)
    monkeypatch.setattr(L, "BLOCK", 2)
    monkeypatch.setattr(L, "MEMORY", 50)
    assert got(docs, 20) == whole


def test_empty(empty):
    assert L.predict(empty).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None, "some text"), (2, None, None)], "doc_id long, lang string, text string")
    assert {(r["lang_pred"], r["score"]) for r in L.predict(docs).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(small.inputFiles()[0].replace("sf0.001", "sf0.01"))
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in L.predict(docs).collect() if r["held_out"]]
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows)
    assert len(rows) > 200 and right >= 0.98 * len(rows)
