import os
from array import array
from collections import Counter

import public_tokenizers as public
from tokenizers import Tokenizer

import corpus_pipeline
from newsloom.llm import minhash
from llm.test_minhash import brute

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def test_stages(spark):
    folder = f"{TESTDATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, results = docs.columns, []
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, folder)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        results.append([r.asDict() for r in docs.collect()])
    good, unique, clean, mixed = results

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert all((labels[d] == 1) == (d in kept) for d in labels if d in kept or labels[d] == 1)
    groups = brute([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in unique) == sorted(set(groups.values()))
    assert [r["doc_id"] for r in clean] and not any("@mail" in r["text"] for r in clean)
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in unique)
    texts = {r["doc_id"]: r["text"] for r in clean}
    assert all(texts[r["doc_id"]] == r["text"] for r in mixed) and max(Counter(r["doc_id"] for r in mixed).values()) <= 2

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    expected = Counter()
    for r in mixed:
        expected.update([(r["doc_id"], t) for t in [*whole.encode(r["text"], add_special_tokens=False).ids, 1]])
    got = Counter()
    for p in pieces:
        got.update([(p["doc_id"], t) for t in array("I", bytes(p["ids"]))])
    assert got == expected


def test_run(spark):
    rows = corpus_pipeline.run(spark, f"{TESTDATA}/sf0.001")
    assert rows.count() > 0 and rows.agg({"length": "sum"}).first()[0] == rows.where("start + length = doc_tokens").agg({"doc_tokens": "sum"}).first()[0]


def test_unique_documents_follow_components(small):
    found = {r["doc_id"] for r in minhash.near_duplicates(small).where("kept").collect()}
    assert {r["doc_id"] for r in minhash.unique_documents(small).collect()} == found
