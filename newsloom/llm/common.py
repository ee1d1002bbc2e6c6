"""Shared pieces: staging in the shared folder, word rules, hashing, batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import stage_table

#: Words are runs of anything but the six ASCII white-space characters, which
#: is also what ``bytes.split()`` cuts at.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives
    lost executors, and gives Spark the true size of small tables. The shuffle
    files behind it are of no more use and are removed at once."""
    conf, setting = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting, "false")
    conf.set(setting, "true")
    try:
        return stage_table(df, f"llm-{name}")
    finally:
        conf.set(setting, before)


def whole(text: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def id_remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def crc_remainder(doc_id, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


# ---- inside tasks -----------------------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (a public finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, computed once per distinct word; emptied
    when full, so memory stays bounded on any vocabulary."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        import xxhash

        self._hash, self._limit = xxhash.xxh64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        value = self._hash(word)
        if len(self) >= self._limit:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_POWERS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += mix64(hashes[k : k + n] + _POWERS[k]) * _POWERS[k]
    return mix64(total)


def rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches, one at a time, without a copy of the batch."""
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


class Buffer:
    """Collects output rows and gives Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, max_rows: int = 20_000, max_bytes: int = 8_000_000):
        self.schema, self.max_rows, self.max_bytes = schema, max_rows, max_bytes
        self._clear()

    def _clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.bytes = 0

    def add(self, *values, weight: int = 0) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.bytes += weight

    def full(self) -> bool:
        return len(self.columns[0]) >= self.max_rows or self.bytes >= self.max_bytes

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)]
        self._clear()
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


BATCH_ROWS = 2048


def map_rows(df: DataFrame, fn, schema: str, rows_at_once: int = 256) -> DataFrame:
    """``fn(iterator of Arrow batches)`` over partitions, in bounded memory.

    Spark sends ``BATCH_ROWS`` rows at a time; the session's setting is lowered
    to that if it is higher. They are cut into short slices (without a copy),
    so that what a task holds and returns at once is small."""
    conf, setting = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(setting)) <= BATCH_ROWS:
        conf.set(setting, BATCH_ROWS)

    def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                yield batch.slice(start, rows_at_once)

    return df.mapInArrow(lambda batches: fn(sliced(batches)), schema)
