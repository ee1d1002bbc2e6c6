import math
import random
import re
from collections import Counter

from newsloom.llm.quality_rules import estimate, estimate_kinds, judge, rules, text_facts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def facts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines, before, dup = [x for x in (text or "").split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        dup += line in before
        before.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated), n < 20 or 100 * len(repeated) > 30 * n


def check(docs):
    rows = judge(docs).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == sorted((str(r["doc_id"]), *facts(r["text"])) for r in docs.collect())
    assert all(not (r["base_failed"] and r["kept"]) for r in rows)
    return rows


def test_documents(spark, small):
    rows = check(small)
    kept = {r["doc_id"]: r["kept"] for r in rows}
    failed = {r["doc_id"] for r in rows if r["base_failed"]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(small.inputFiles()[0].replace("documents", "labels")).collect()}
    bad = [kept[d] for d, q in labels.items() if q == 0]
    good = [kept[d] for d, q in labels.items() if q == 1 and d not in failed]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_odd_rows(odd):
    check(odd)


def test_empty(empty):
    assert judge(empty).count() == 0


def test_estimates_recover_planted_accuracies():
    patterns = Counter()
    for good in (0, 1):
        for a in (0, 1):
            for b in (0, 1):
                for c in (0, 1):
                    p = (0.7 if good else 0.3)
                    for vote, right in ((a, 0.9), (b, 0.8), (c, 0.7)):
                        p *= right if vote == good else 1 - right
                    patterns[a, b, c] += round(1_000_000 * p)
    prior, table = estimate(sorted(patterns.items()), rounds=400)
    assert abs(prior - 0.7) < 0.05
    for (bad, good), right in zip(table, (0.9, 0.8, 0.7)):
        assert abs(good[1] - right) < 0.05 and abs(bad[0] - right) < 0.05


def plain_kinds(documents, rounds=60, false_alarm=0.01):
    """The same model document by document, without patterns; numbers only."""
    import numpy as np

    votes = np.array(documents)
    n, width = votes.shape
    counted = sorted(Counter(map(tuple, documents)).items())
    prior, table = estimate(counted, rounds)
    log_odds = np.full(n, math.log(prior / (1 - prior)))
    for r in range(width):
        log_odds += np.log(np.array(table[r][1]) / np.array(table[r][0]))[votes[:, r]]
    bad = votes == 0
    start = np.where(bad.any(1), np.maximum(1 / (1 + np.exp(log_odds)), 0.5), 0)
    z = np.column_stack([1 - start, bad / np.arange(1, width + 1) * (start / np.maximum((bad / np.arange(1, width + 1)).sum(1), 1e-9))[:, None]])
    one_hot = np.stack([votes == v for v in range(3)], 2).astype(float)
    for _ in range(rounds):
        freq = (z.sum(0) + 0.5) / (n + 0.5 * (width + 1))
        p = np.einsum("dc,drv->crv", z, one_hot[:, :, :2]) + 0.5
        share = p[:, :, 0] / p.sum(2)
        share[0] = np.minimum(share[0], false_alarm)
        for r in range(width):
            share[r + 1, r] = max(share[r + 1, r], 0.9)
        p = np.stack([share, 1 - share, np.ones_like(share)], 2)
        logs = np.log(freq) + np.einsum("drv,crv->dc", one_hot, np.log(p))
        z = np.exp(logs - logs.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
    return z[:, 0]


def test_posterior_against_plain_model(spark, small):
    names = list(rules())
    facts = sorted(text_facts(small).withColumns(rules()).collect(), key=lambda r: r["doc_id"])
    want = plain_kinds([tuple(r[n] for n in names) for r in facts])
    got = {r["doc_id"]: r["posterior"] for r in judge(small).collect()}
    assert max(abs(got[r["doc_id"]] - w) for r, w in zip(facts, want)) < 1e-9


def test_effect_on_labels(spark, small):
    """Of the bad documents that pass the base rule most are refused; good ones stay."""
    path = small.inputFiles()[0].replace("sf0.001", "sf0.01")
    passed = {r["doc_id"]: r["kept"] for r in judge(spark.read.parquet(path)).collect() if not r["base_failed"]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(path.replace("documents", "labels")).collect()}
    good = [kept for d, kept in passed.items() if labels.get(d) == 1]
    bad = [kept for d, kept in passed.items() if labels.get(d) == 0]
    assert len(bad) > 10 and sum(bad) <= 0.5 * len(bad) and sum(good) >= 0.97 * len(good)


def test_kinds_that_no_other_rule_sees():
    """Two ways of being bad, each seen by its own rule; the rarer one counts too."""
    draw, documents = random.Random(3), []
    for _ in range(20_000):
        kind = draw.choices((0, 1, 2), (90, 8, 2))[0]
        documents.append((kind, tuple(0 if draw.random() < (0.95 if kind in on else 0.005) else 1 for on in ((1,), (1,), (2,), ()))))
    frequency, votes_of = estimate_kinds(sorted(Counter(v for _, v in documents).items()))
    assert abs(frequency[0] - 0.9) < 0.02 and abs(frequency[3] - 0.02) < 0.01
    assert all(rule[0] <= 0.01 + 1e-12 for rule in votes_of[0]) and votes_of[3][2][0] > 0.8
