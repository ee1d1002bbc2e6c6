"""Packing by concatenation and cutting.

First pass: every task tokenises its documents, numbers the tokens inside its
block (a running sum, no shuffle) and the result is staged. The block totals,
one row per task, are summed into block offsets, which gives every document its
place in one global stream. Second pass: the stream is cut every ``length``
tokens; a document that crosses a cut gives one record per window, so every
token lies in exactly one piece and only the last window is not full.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import Buffer, map_rows, rows, stage

#: A token of the vocabulary never holds a non-space followed by a space, so a
#: text may be cut there and the parts looked up one by one.
_PART = re.compile("[ \\t-\\r]*[^ \\t-\\r]+|[ \\t-\\r]+")
#: Texts with rarer characters or other kinds of space are encoded whole.
_RARE = re.compile("[^\\x00-\\x1b\\x20-\\x7f\\xa1-\\u024f\\u2010-\\u2027]")
_SPECIAL = "<|endoftext|>"

TOKENS = "doc_id bigint, block int, local bigint, n bigint, ids binary"


class Encoder(dict):
    """Byte-level BPE: part of a text -> its ids as little-endian uint32.

    Ids are those of ``tokenizers`` on the whole text without added special
    tokens. Parts seen before come from a bounded table; new ones are merged
    from the rank file of the same vocabulary. The model file is only loaded
    when a text has to be encoded whole."""

    def __init__(self, model: str, ranks: str, pattern: str, limit: int = 100_000):
        super().__init__()
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self._model, self._limit = model, limit

    @cached_property
    def _whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._model)

    def __missing__(self, part: str) -> bytes:
        ids = array("I", self._merge(part)).tobytes()
        if len(self) >= self._limit:
            self.clear()
        self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if _RARE.search(text) or _SPECIAL in text:
            return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, _PART.findall(text)))


def tokenised(docs: DataFrame, files: tuple[str, str, str] | None = None, end_id: int = 1) -> DataFrame:
    """Staged ``doc_id, block, local, n, ids``. ``files``: model file, rank file
    and split pattern, as paths that executors can open."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if files is None:
            import public_tokenizers as public

            encoder = Encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
        else:
            encoder = Encoder(*files)
        end = array("I", [end_id]).tobytes()
        block, local = TaskContext.get().partitionId(), 0
        out = Buffer(pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("local", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]))
        for doc_id, text in rows(batches, "doc_id", "text"):
            ids = encoder.ids(text or "") + end
            n = len(ids) // 4
            out.add(doc_id, block, local, n, ids, weight=len(ids))
            local += n
            if out.full():
                yield out.take()
        yield out.take()

    return stage(map_rows(docs.select(F.col("doc_id").cast("long"), "text"), encode, TOKENS), "tokens")


def cut(tokens: DataFrame, length: int = 2048) -> DataFrame:
    """Pieces of a staged token table: ``doc_id, start, length, ids,
    doc_tokens, sequence_id, offset``; ``ids`` are little-endian uint32."""
    totals = stage(tokens.groupBy("block").agg(F.sum("n").alias("total")), "token-totals")
    before = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("block_start"))
    placed = tokens.join(stage(offsets, "token-offsets"), "block").withColumn("first", F.col("block_start") + F.col("local"))
    size = F.lit(length).cast("long")
    windows = F.sequence(F.floor(F.col("first") / size), F.floor((F.col("first") + F.col("n") - 1) / size))
    return (
        placed.select("doc_id", "first", F.col("n").alias("doc_tokens"), F.col("ids").alias("__ids"), F.explode(windows).alias("sequence_id"))
        .withColumn("__from", F.greatest(F.col("first"), F.col("sequence_id") * size))
        .withColumn("length", F.least(F.col("first") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * size) - F.col("__from"))
        .select(
            "doc_id", (F.col("__from") - F.col("first")).alias("start"), "length",
            F.col("__ids").substr(((F.col("__from") - F.col("first")) * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids"),
            "doc_tokens", "sequence_id", (F.col("__from") - F.col("sequence_id") * size).alias("offset"),
        )
    )


def pack(docs: DataFrame, length: int = 2048, files: tuple[str, str, str] | None = None, end_id: int = 1) -> DataFrame:
    """Pack all rows of ``docs`` (``doc_id, text``; other columns are ignored).

    A null or empty text is the end id alone; a very long text spans as many
    windows as it needs; repeated rows are packed as often as they come; an
    empty table gives no pieces; null ids stay null."""
    return cut(tokenised(docs, files, end_id), length)
