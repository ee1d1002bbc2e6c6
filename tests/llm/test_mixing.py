import re
from collections import defaultdict

import pytest

from newsloom.llm.mixing import mix, mixed_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, cycle=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weights[s] for s in free)
        over = [s for s in free if level * weights[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * weights[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def check(docs):
    rows = mix(docs).collect()
    texts = sorted((str(r["doc_id"]), str(r["source"]), len(WORD.findall(r["text"] or ""))) for r in docs.collect())
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in rows) == texts
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    goal = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= longest[s] / 2 + 1e-6
    return rows


def test_documents(small):
    rows = check(small)
    assert sorted(map(str, mix(small.repartition(7)).collect())) == sorted(map(str, rows))


def test_odd_rows(odd):
    check(odd)


def test_rows_of_the_mix(small):
    taken = {r["doc_id"]: r["copies"] for r in mix(small).collect()}
    out = mixed_documents(small)
    assert out.columns == small.columns
    found = defaultdict(int)
    for r in out.collect():
        found[r["doc_id"]] += 1
    assert found == {k: n for k, n in taken.items() if n}


def test_empty(empty):
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0


def repeated(spark, ids):
    rows = [(ids(k, s), "w " * 10, f"s{s}", k, 1, "clash") for s in range(3) for k in range(1000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, among long, ties long, last string")


@pytest.mark.parametrize("ids", [
    lambda k, s: 5 if s == 1 else s * 1000 + k, lambda k, s: None, lambda k, s: k % 3, lambda k, s: None if k % 2 else k])
def test_repeated_ids_meet_the_target(spark, ids):
    """One id for a whole source, no ids at all, few ids: targets hold, and the
    rows of the mix are as many as the decisions say."""
    docs = repeated(spark, ids)
    rows = check(docs)
    again = mix(docs.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["source"], r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixed_documents(docs).count() == sum(r["copies"] for r in rows)


def plain_pareto(docs, mixed):
    """Rank by the odds of the same uniform numbers, take in order until the source is full."""
    import math

    from newsloom.llm.mixing import _uniform, sized

    uniform = {r["doc_id"]: r["u"] for r in sized(docs).select("doc_id", _uniform("doc_id", "size", 20).alias("u")).collect()}
    by_source = defaultdict(list)
    for r in mixed:
        by_source[r["source"]].append(r)
    out = {}
    for rows in by_source.values():
        size, target = sum(r["size"] for r in rows), rows[0]["target"]
        mass = defaultdict(int)
        for r in rows:
            mass[r["size"].bit_length()] += r["size"]
        free, rate, left = {c for c in mass if mass[c]}, {}, target
        pull = {c: 2.0 ** (-0.125 * c) for c in mass}
        while free:
            level = left / sum(pull[c] * mass[c] for c in free)
            over = [c for c in free if level * pull[c] > 2]
            if not over:
                rate |= {c: level * pull[c] for c in free}
                break
            for c in over:
                rate[c] = 2.0
                left -= 2 * mass[c]
                free.discard(c)
        rate.setdefault(0, min(2.0, target / size) if size else 0.0)
        rate = {c: round(x) if abs(x - round(x)) < 1e-9 else x for c, x in rate.items()}
        lack, ranked = target, []
        for r in rows:
            x = rate[r["size"].bit_length()]
            out[r["doc_id"]] = math.floor(x)
            lack -= math.floor(x) * r["size"]
            if (p := x - math.floor(x)) > 0:
                u = uniform[r["doc_id"]]
                odds = u / (1 - u) * (1 - p) / p
                ranked.append((odds / (1 + odds), r["doc_id"], r["size"]))
        for _, doc_id, n in sorted(ranked):
            if lack - n / 2 < 0 and n:
                break
            out[doc_id] += 1
            lack -= n
    return out


def test_against_plain_pareto(small):
    rows = mix(small).collect()
    assert {r["doc_id"]: r["copies"] for r in rows} == plain_pareto(small, rows)
