import os

import numpy as np

from newsloom.llm import classifier
from newsloom.llm.classifier import Features, Machine, WIDTH, accepted_documents, classify, fit
from newsloom.llm.common import crc_remainder

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{TESTDATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["held_out"] == (crc_remainder(r["doc_id"], 5) == 0) for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(y == p for y, p in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_odd_rows_and_labels(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (9, None), (None, 1), (5, 1), (10, 0), (99, 1)], "doc_id long, quality int")
    assert sorted(str(r["doc_id"]) for r in classify(odd, labels).collect()) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert classify(empty, labels).count() == 0
    assert classify(odd, labels.limit(0)).where("score BETWEEN 0.3 AND 0.7").count() == odd.count()
    out = accepted_documents(odd, labels.limit(0))
    assert out.columns == odd.columns and out.count() == odd.count()


def test_pairs_in_linear_time():
    random = np.random.default_rng(0)
    model = Machine(0.3, random.normal(size=WIDTH), random.normal(size=(WIDTH, 4)))
    indices, values = Features()("some words and some more words! #1", 30)
    pairs = sum(model.factors[a] @ model.factors[b] * x * y for i, (a, x) in enumerate(zip(indices, values)) for b, y in list(zip(indices, values))[i + 1 :])
    assert np.isclose(model.margin(indices, values), model.bias + model.linear[indices] @ values + pairs, rtol=1e-4)


def test_interactions_are_learnt():
    """Exclusive or: no linear model can tell these apart."""
    random = np.random.default_rng(5)
    examples = []
    for _ in range(2000):
        a, b = random.integers(0, 2, 2)
        examples.append((int(a ^ b), np.array([10 + a, 20 + b], np.int32), np.ones(2, np.float32)))
    model = fit(examples, epochs=20)
    assert np.mean([(model.score(i, v) >= 0.5) == y for y, i, v in examples]) > 0.97


def test_repeated_rows_push_out_no_others(spark, monkeypatch):
    """Every chosen document is learnt from once, whatever one id repeats."""
    taken = []
    monkeypatch.setattr(classifier, "fit", lambda examples, **_: taken.append(len(examples)))
    ids = [i for i in range(60) if crc_remainder(i, 5) != 0][:20]
    rows = [(ids[0], f"hot text {k % 3}", 10) for k in range(500)] + [(i, f"text of {i}", 9) for i in ids[1:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    classifier.train(docs, labels, max_rows=20)
    assert taken == [20]
