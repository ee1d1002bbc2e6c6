import re
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import phrases as P
from tests.compare import compare, duck


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), a in cand.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w) and 100 * a >= 100 * f[lang, w[i:j]]:
                    covered.add((lang, w[i:j]))
    rows = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in covered:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in rows.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def got(docs, **settings):
    rows = P.collocations(docs, **settings).collect()
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows)


def given(docs):
    return [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]


def test_small_table(small):
    want = plain(given(small), 10, 2000)
    assert len(want) > 100 and {len(r[2].split()) for r in want} == {2, 3, 4, 5}
    assert got(small, least=10) == want


def test_odd_rows(odd):
    assert got(odd, least=2, top=50) == plain(given(odd), 2, 50)


def test_ties_overlaps_and_marks(spark, monkeypatch):
    """Overlapping repeats, equal scores, marks, other blanks, clashing columns;
    few slots and small tables in the tasks change nothing."""
    text = ["a a a a a b", "B a. b A; x\x1cy z\tx\x1cy z", "é ü q é ü q", "c d e f g c d e f g", "c d e\x0bf g", "one two one two"]
    rows = [((None, "und", "", "en")[i % 4], text[i % 6], "clash", 1, 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string, phrase string, n long, rank long").repartition(3)
    want = plain([r[:2] for r in rows], 5, 2000)
    assert got(docs, least=5) == want and want
    monkeypatch.setattr(P, "ENTRIES", 3)
    monkeypatch.setattr(P, "VOCABULARY", 4)
    monkeypatch.setattr(P, "STRIPE_BITS", 1)
    monkeypatch.setattr(P, "BYTES", 40)
    assert got(docs, least=5, slots=4) == want


def test_no_row_per_stripe(spark):
    """What the tasks send is made into one row per entry, at once: no rows are made
    per task and prefix, whose number grows faster than the text."""
    docs = spark.createDataFrame([("en", "a b a c a b"), ("en", "a b d a b")], "lang string, text string").repartition(2)
    parts = P.stripes(docs, 2, np.full(4, 8, np.uint8))
    plan = P.merged(parts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1
    for r in parts.collect():
        assert len(r["p1"]) == len(r["p2"]) == len(r["next"]) == len(r["n"])
        assert sorted(r["p1"], key=lambda x: x % 2**64) == r["p1"]
    assert sorted(r["n"] for r in P.merged(parts).collect()) == [1, 1, 1, 1, 1, 4]  # ab four times


def test_exact_beyond_64_bits(spark):
    """1000 * a * n passes 64 bits; a rounded product would give another score."""
    big = 9_007_199_254_740_993
    row = [("en", "", w, n) for w, n in (("x", big), ("y", big - 2))]
    two = [("en", "x", "x y", big - 4)]
    ddl = "lang string, prefix string, phrase string, n long"
    found = [spark.createDataFrame(row, ddl), spark.createDataFrame(two, ddl)]
    totals = spark.createDataFrame([("en", 2 * big)], "lang string, n long")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(P, "levels", lambda *a: (totals, found))
        [score] = [r["score"] for r in P.collocations(totals).collect()]
    assert score == 1000 * (big - 4) * 2 * big // (big * (big - 2))


def test_empty(empty):
    assert P.collocations(empty).count() == 0


def test_sql(spark, small):
    import os

    folder = os.path.dirname(small.inputFiles()[0].removeprefix("file:")).replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert compare(duck(folder), P.collocations(docs), P.SQL) == []


def test_hashes_are_converted_once():
    words = P.Words()
    for word in (b"a", b"b", b"a"):
        words[word]
    first = words.hashed()
    assert words.hashed() is first and first.tolist() == words.hashes
    words[b"c"]
    assert words.hashed().tolist() == words.hashes and len(words.hashes) == 5
