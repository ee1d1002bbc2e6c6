import inspect
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import newsloom.llm.suffix_tree as module
from newsloom.llm.suffix_tree import BITS, END, Tree, grow, positions, score


def words(text):
    return (text or "").encode().lower().split()


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def check(docs, **settings):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts = Counter(w for i, t in rows if not held(i) for w in [*words(t), END])
    n, v = sum(counts.values()), len(counts)
    got = score(docs, **settings).collect()
    expected = []
    for i, t in rows:
        tokens = [*words(t), END]
        expected.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    got_rows = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    for a, b in zip(got_rows, sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    return got


def slow_model(texts, depth, share, least, least_count, divergence):
    """The tree as dictionaries, from its definition."""
    lists = [[*words(t), END] for t in texts]
    count = Counter(w for t in lists for w in t)
    total, scale = sum(count.values()), sum(count.values()) + len(count) + 1
    listed = {w for w, n in count.items() if n >= share * total} | {END}
    name = lambda w: w if w in listed else None
    root = {w: (count[w] + 1) / scale for w in listed}
    root[None] = 1 - sum(root.values())
    n = [defaultdict(Counter) for _ in range(depth + 1)]
    for t in lists:
        s = [END] * depth + [name(w) for w in t]
        for p in range(depth, len(s)):
            for d in range(1, depth + 1):
                n[d][tuple(s[p - d : p])][s[p]] += 1
    states = {}

    def p(context, x):
        for d in range(len(context), 0, -1):
            c = context[len(context) - d :]
            if c in states:
                t, u = sum(states[c].values()), len(states[c])
                return (states[c][x] + u * p(c[1:], x)) / (t + u)
        return root[x]

    for d in range(1, depth + 1):
        for c, following in list(n[d].items()):
            t = sum(following.values())
            if t >= max(least * total, least_count):
                gain = sum(k / t * math.log(k / t / p(c[1:], x)) for x, k in following.items())
                if gain >= divergence and gain * t >= 0.5 * len(following) * math.log(t + 1):
                    states[c] = following
    return lambda words: sum(
        math.log10(p(tuple(([END] * depth + [name(w) for w in words])[k : k + depth]), name(w)) / root[name(w)] * (count[w] + 1) / scale)
        for k, w in enumerate(words)), states


def test_documents(small):
    rows = check(small, known_words=300)
    settings = {"depth": 2, "share": 1e-3, "least": 1e-4, "least_count": 10, "divergence": 0.03}
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    log10, states = slow_model([t for i, t in texts.items() if not held(i)], **settings)
    assert 50 < len(states)
    for r in score(small, **settings).where("doc_id < 40").collect():
        assert r["score"] == pytest.approx(log10([*words(texts[r["doc_id"]]), END]), rel=1e-9)
    # The tree predicts unseen texts better than single words do.
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_odd_rows(odd, empty):
    check(odd)
    check(odd, known_words=1)
    assert score(empty).count() == 0
    nothing = check(odd.where("crc32(cast(doc_id AS string)) % 7 = 2"))
    assert all(r["train_tokens"] == 0 for r in nothing)


def test_distributions_sum_to_one():
    rng = np.random.default_rng(0)
    text = rng.choice(8, 4000, p=[0.1, 0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05])
    text[1::3] = text[::3][: len(text[1::3])]
    codes, _ = positions([text], 2)
    levels = [np.unique(codes & ((1 << BITS * (d + 1)) - 1), return_counts=True) for d in (1, 2)]
    tree = grow(np.full(8, 1 / 8), levels, 0.0)
    assert isinstance(tree, Tree) and len(tree.contexts[0]) and len(tree.contexts[1])
    for a in range(8):
        for b in range(8):
            assert (10 ** tree.log10((a << 2 * BITS) + (b << BITS) + np.arange(8))).sum() == pytest.approx(1)


def test_every_word_and_context_counts(small, monkeypatch):
    """No share bounds the tree: rare words are symbols, contexts have four words,
    and frequent ones, dealt to several cells, give what whole ones would."""
    monkeypatch.setattr(module, "CUT", 50)
    monkeypatch.setattr(module, "CHUNK_TOKENS", 4000)
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    defaults = {name: p.default for name, p in inspect.signature(score).parameters.items()}
    assert defaults["depth"] >= 4 and defaults["share"] == defaults["least"] == 0
    log10, states = slow_model([t for i, t in texts.items() if not held(i)], 4, 0, 0, 3, 0.02)
    assert {1, 2, 3, 4} <= {len(c) for c in states}
    for r in check(small.repartition(3), least_count=3):
        if r["doc_id"] < 40:
            assert r["score"] == pytest.approx(log10([*words(texts[r["doc_id"]]), END]), rel=1e-9)


def test_a_phrase_between_rare_words(spark):
    """A phrase of words far below any share of the corpus is predicted."""
    rows = [(i, f"{' '.join(f'w{(i * 7 + j * j) % 997}' for j in range(200))} quint sext sept oct") for i in range(200)]
    rows += [(i, "quint sext sept oct" if i % 2 else "oct sept sext quint") for i in range(1000, 1100)]
    found = {r["doc_id"]: r["score"] - r["base_score"] for r in score(spark.createDataFrame(rows, "doc_id long, text string"), share=0.0).where("doc_id >= 1000").collect()}
    assert min(v for i, v in found.items() if i % 2) > max(v for i, v in found.items() if i % 2 == 0)
