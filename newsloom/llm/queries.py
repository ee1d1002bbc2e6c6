"""Queries of the numbered operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import classifier, conversations, languages, minhash, mixing, packing, passages, phrases, pii, quality_rules, secrets, suffix_tree, vectors
from newsloom.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def _joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _digest(found: DataFrame, kinds) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    base = F.sha2(_joined(F.filter("spans", lambda s: s["base"])).cast("binary"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query()
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.find(documents(spark, sf_dir)), pii.BASE)


@query()
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


@query()
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(documents(spark, sf_dir))


@query()
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query()
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secrets.find(documents(spark, sf_dir)), secrets.BASE)


@query()
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query()
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(documents(spark, sf_dir))


@query()
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


@query(phrases.SQL)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


@query()
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.predict(documents(spark, sf_dir))


@query()
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def catalogue() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    return dict(QUERIES), dict(ORACLES)
