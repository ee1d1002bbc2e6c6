"""Incremental ingest of new dump files.

The batch form of "skip what is already there" needs a scan of existing days.
As a file stream the same rule is kept by the checkpoint: each dump file is
parsed and classified once, whenever the job is started.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions import extract as X
from newsloom.plans.ingest import classify_messages, dedupe_media, extract_items
from newsloom.session import stage_table
from newsloom.sources import dumps as source

# Fixed value: the columns of Spark's source of whole files.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def message_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of the dump files that arrive in ``folder``."""
    raw = spark.readStream.schema("value string").option("wholetext", True).text(folder)
    texts = raw.select(F.explode(source.dump_texts(F.col("value"))).alias("text"))
    return source.parse_record_header(source.split_records(texts))


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Names of the dump files that arrive in ``folder`` (a glob may be given):
    ``path``. The contents are not read here."""
    source_ = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_batch)
    return source_.load(folder).select("path")


def new_media(items: DataFrame, earlier: DataFrame) -> DataFrame:
    """G6 over batches: the items without the videos that an earlier batch has
    (same day, time and cleaned description). Of the earlier items only the keys
    of the batch's range of days are read."""
    keys = ["date", "time", "media_key"]
    videos = items.where(F.col("category") == "videos")
    span = videos.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    if span["a"] is None:
        return items
    stored = earlier.where((F.col("category") == "videos") & F.col("date").between(F.lit(span["a"]), F.lit(span["b"]))).select(*keys)
    held = stored.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return items.where(F.col("category") != "videos").unionByName(videos.join(held, same, "left_anti"))


def ingest_new_dumps(spark: SparkSession, folder: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Add the items of all new files to ``target`` (a folder per batch), then
    stop. ``checkpoint`` is a lasting folder: a later session that names it goes
    on after the last finished file.

    The stream carries file names, at most ``files_per_batch`` in a batch; a
    batch reads its files with the batch reader, which cuts large ones. Noise and
    other messages are left out. Repeated videos are dropped inside a batch and
    against all earlier ones, so of copies in several batches the one that came
    first stays. A batch that is run again after a failure has the same files,
    looks at the batches before it only, and replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        files = [r["path"] for r in batch.collect()]  # bounded by files_per_batch
        if not files:
            return
        items = extract_items(classify_messages(source.read_messages(session, files)))
        # Staged before the videos go their own way: extraction runs once.
        staged = stage_table(items.where(~F.col("category").isin(X.NOISE, X.OTHER)), "batch", partition_by="category")
        kept = dedupe_media(staged.select(*items.columns))
        if number > 0:
            # An explicit schema: earlier batches may have written nothing.
            stored = session.read.schema(T.StructType(kept.schema.fields + [T.StructField("batch", T.LongType())])).parquet(target)
            kept = new_media(kept, stored.where(F.col("batch") < number))
        kept.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return file_stream(spark, folder, files_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
