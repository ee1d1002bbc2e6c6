import random

import numpy as np

from newsloom.llm.components import components
from newsloom.llm.minhash import Signatures, near_duplicates, unique_documents


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    """component per id, by comparing all pairs that share a shingle."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    for k, (i, s) in enumerate(sets):
        for other in {o for g in s for o in holders[g] if o < k}:
            j, t = sets[other]
            common = len(s & t)
            if 100 * common >= 75 * (len(s) + len(t) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def check(docs, **settings):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = brute(rows)
    got = near_duplicates(docs, **settings).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=key) == sorted(
        ((i, len(shingle_set(t)), expected.get(i), True if i is None else i == expected[i]) for i, t in rows), key=key)


def test_documents(small):
    check(small)


def test_odd_rows(odd):
    check(odd)
    out = unique_documents(odd)
    assert out.columns == odd.columns and sum(r["doc_id"] == 6 for r in out.collect()) == 1


def test_empty(empty):
    assert near_duplicates(empty).count() == 0 and unique_documents(empty).count() == 0


def edited(words, edits, vocabulary, rng):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return out


def test_groups_without_a_hub_and_shared_passages(spark):
    """Chains at the threshold, hubs with the largest id, short texts, and a
    passage that a third of the documents share."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for size in (8, 40, 120, 300):
        for _ in range(4):
            base = text(size)
            group = [edited(base, rng.randint(0, max(1, size // 30)), vocabulary, rng) for _ in range(12)]
            texts += group + [base]
    chain = text(200)
    for _ in range(40):
        texts.append(chain)
        chain = edited(chain, 4, vocabulary, rng)
    passage = text(60)
    for _ in range(250):
        words = text(rng.randint(40, 90))
        texts.append(words[:20] + passage + words[20:])
    near = [edited(passage + text(15), 1, vocabulary, rng) for _ in range(30)]
    texts += near + [text(rng.randint(1, 7)) for _ in range(60)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(3 * i, " ".join(texts[k])) for i, k in enumerate(order)], "doc_id long, text string").repartition(6)
    check(docs)
    check(docs, counters=64)  # any order gives the same links


def test_signatures_collide_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    signatures = Signatures(bands=200, band_rows=1)
    for size, extra in ((3, 1), (30, 10), (600, 200)):
        agree = []
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a, rng.integers(0, 2**63, extra, dtype=np.int64).astype(np.uint64) * np.uint64(2)]))
            agree.append((signatures(a) == signatures(b)).mean())
        assert abs(np.mean(agree) - 0.75) < 0.04


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 4000 + i) for i in range(80)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
