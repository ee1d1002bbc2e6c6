"""Near-duplicate documents: one-permutation hashing with optimal
densification, banded buckets and star-shaped candidate edges.

1. The shingles of a document are hashed once; each falls into one of
   ``bands * band_rows`` bins and the bin keeps its smallest value. An empty bin
   borrows from the first filled bin of an order fixed for it. Runs of
   ``band_rows`` bins are bucket keys.
2. Documents with equal sets become one class; only its representative goes on.
3. In each bucket the document that shares most buckets is the centre; every
   other member is paired with it alone, so a bucket gives fewer pairs than
   members. Pairs are confirmed on the full sets.
4. A bucket whose members are then still in several components may hide links
   between members. Those documents are joined exactly: sorted by (rough)
   frequency, two sets with similarity s share one of their n - ceil(s n) + 1
   rarest shingles. Frequent shared passages are no candidates this way. The
   frequencies are a table of fixed size; any order keeps the join exact.

A pair at similarity 0.75 shares no bucket with probability 4e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import WordHashes, map_rows, mix64, stage, window_hashes
from newsloom.llm.components import components

WORDS = 5
BANDS, BAND_ROWS = 45, 4
COUNTERS = 1 << 18
BROADCAST_ROWS = 1_000_000  # ids; 16 MB


def shingles(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word hashes."""
    if len(hashes) == 0:
        return hashes
    return np.unique(window_hashes(hashes, words if len(hashes) >= words else len(hashes)))


class Signatures:
    def __init__(self, bands: int = BANDS, band_rows: int = BAND_ROWS, seed: int = 10):
        self.bins, self.shape = bands * band_rows, (bands, band_rows)
        random = np.random.default_rng(seed)
        self.donors = np.stack([random.permutation(self.bins) for _ in range(self.bins)])
        self.powers = mix64(np.arange(1, band_rows + 1, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)
        self.numbers = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(1000 + seed))

    def __call__(self, sorted_set: np.ndarray) -> np.ndarray:
        """Bucket keys, one per band. The bin is the leading part of the hash,
        so a sorted set falls into consecutive bins."""
        bins = ((sorted_set >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(bins, prepend=-1))
        values = np.zeros(self.bins, np.uint64)
        filled = np.zeros(self.bins, bool)
        filled[bins[starts]] = True
        values[bins[starts]] = np.minimum.reduceat(mix64(sorted_set), starts)
        if len(starts) < self.bins:
            lender = self.donors[np.arange(self.bins), filled[self.donors].argmax(1)]
            values = np.where(filled, values, values[lender])
        return mix64((values.reshape(self.shape) * self.powers).sum(1, dtype=np.uint64) + self.numbers).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column("text")
        yield batch.column("doc_id"), [shingles(hashes.of((texts[i].as_py() or "").encode().lower().split())) for i in range(batch.num_rows)]


def _fingerprint(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64), kind))


def facts(docs: DataFrame) -> DataFrame:
    """Staged ``doc_id, n, fp, keys``: set size, fingerprint of the set, bucket
    keys (none for an empty set)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures()
        none = np.empty(0, np.int64)
        for ids, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                _lists([signatures(s) if len(s) else none for s in sets], pa.int64()),
            ], names=["doc_id", "n", "fp", "keys"])

    return stage(map_rows(docs.select(F.col("doc_id").cast("long"), "text"), compute, "doc_id bigint, n bigint, fp binary, keys array<bigint>"), "minhash-facts")


def _bounded(ids: DataFrame) -> DataFrame:
    """Broadcast a list of ids if it is short enough; else join by shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Staged ``id, n, grams`` of the documents in ``wanted`` (``doc_id``)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), _lists(sets, pa.int64())], names=["id", "n", "grams"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_bounded(wanted), "doc_id", "left_semi")
    return stage(map_rows(chosen, compute, "id bigint, n bigint, grams array<bigint>"), "minhash-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (``id1, id2``) that meet the threshold, as ``a, b``. Sizes are
    compared first, so that only sets which may link are brought together."""
    for side in ("1", "2"):
        pairs = pairs.join(sets.select(F.col("id").alias(f"id{side}"), F.col("n").alias(f"n{side}")), f"id{side}")
    likely = pairs.where(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")).select("id1", "id2").distinct()
    left = sets.select(F.col("id").alias("id1"), F.col("grams").alias("g1"))
    right = sets.select(F.col("id").alias("id2"), F.col("grams").alias("g2"))
    common = F.size(F.array_intersect("g1", "g2"))
    joined = likely.join(right, "id2").join(left, "id1").withColumn("__common", common)
    return stage(
        joined.where(100 * F.col("__common") >= percent * (F.size("g1") + F.size("g2") - F.col("__common")))
        .select(F.col("id1").alias("a"), F.col("id2").alias("b")), "minhash-links")


def _rarest(exact: DataFrame, counters: int, percent: int) -> DataFrame:
    """Prefix of every set under the order (counter, hash), with the position
    of each shingle in it."""
    shift = 64 - counters.bit_length() + 1
    slot = F.shiftrightunsigned(F.col("gram"), shift).cast("int")
    counted = exact.select(F.explode("grams").alias("gram")).groupBy(slot.alias("slot")).count().toArrow()  # at most `counters` rows
    table = np.zeros(counters, np.int64)
    table[counted["slot"].to_numpy()] = counted["count"].to_numpy()

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("grams")
            kept, places, owner = [], [], []
            for i in range(batch.num_rows):
                own = grams[i].values.to_numpy(zero_copy_only=False)
                n = len(own) - -(-percent * len(own) // 100) + 1
                kept.append(own[np.lexsort((own, table[(own.view(np.uint64) >> np.uint64(shift)).astype(np.int64)]))[:n]])
                places.append(np.arange(len(kept[-1])))
                owner.append(np.full(len(kept[-1]), i))
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (kept, places, owner)]
            take = pa.array(flat[2], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64()), *[batch.column(c).take(take) for c in ("id", "n", "component")]],
                names=["gram", "place", "id", "n", "component"])

    return map_rows(exact.select("id", "n", "component", "grams"), prefix, "gram bigint, place bigint, id bigint, n bigint, component bigint")


def _late_pairs(exact: DataFrame, counters: int, percent: int) -> DataFrame:
    """All pairs of different components that may link. Of a pair that does, the
    first common shingle in the order lies so far in front in both sets that
    what follows can still reach the overlap."""
    prefixes = stage(_rarest(exact, counters, percent), "minhash-prefixes")
    meeting = prefixes.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("gram")
    met = stage(prefixes.join(meeting, "gram").withColumn("rest", F.col("n") - F.col("place")).drop("place"), "minhash-met")
    one, two = (met.select("gram", *[F.col(c).alias(f"{c}{k}") for c in ("id", "n", "rest", "component")]) for k in (1, 2))
    possible = (
        (F.col("component1") < F.col("component2"))
        & ((100 + percent) * F.least("rest1", "rest2") >= percent * (F.col("n1") + F.col("n2")))
        & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    )
    return one.join(two, (one["gram"] == two["gram"]) & possible).select("id1", "id2").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, counters: int = COUNTERS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``
    (``doc_id, text``; other columns are ignored).

    Null, empty and blank texts have empty sets and link with nothing. Rows
    with the same id are one document, linked with what any of its texts links
    with. A row without an id links with nothing and is kept. An empty table
    gives an empty result."""
    known = facts(docs)
    # The representative of a class of equal sets is its smallest id.
    classes = known.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("__copies"))
    shared = stage(classes.where("__copies > 1").select("fp", "rep"), "minhash-classes")
    classed = known.join(_bounded(shared), "fp", "left").withColumn("rep", F.coalesce("rep", "doc_id"))

    members = classed.where("n > 0 AND rep = doc_id").select(F.col("rep").alias("id"), F.explode("keys").alias("key"))
    crowds = members.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    crowded = stage(members.join(crowds, "key"), "minhash-crowded")
    shares = stage(crowded.groupBy("id").agg(F.sum("crowd").alias("shares")), "minhash-shares")
    centres = crowded.join(shares, "id").groupBy("key").agg(F.max(F.struct("shares", "id")).alias("c"))
    stars = crowded.join(centres, "key").where(F.col("id") != F.col("c.id")).select(F.col("c.id").alias("id1"), F.col("id").alias("id2")).distinct()
    sets = full_sets(docs, shares.select(F.col("id").alias("doc_id")))
    links = _confirmed(stars, sets, percent)
    labels = stage(components(links), "minhash-labels")

    # Buckets that still hold several components are joined exactly.
    placed = crowded.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    open_ = stage(placed.join(mixed, "key").select("id", "component").distinct(), "minhash-open")
    exact = stage(sets.join(_bounded(open_), "id"), "minhash-exact")
    more = _confirmed(_late_pairs(exact, counters, percent), sets, percent)
    if not more.isEmpty():
        labels = stage(components(links.unionByName(more)), "minhash-labels")

    found = classed.select("doc_id", "n", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def unique_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that remain: one document of each component, and of
    repeated rows with its id the first; rows without an id stay."""
    found = near_duplicates(docs, **settings)
    counts = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows"), F.min("kept").alias("__kept"))
    odd = stage(counts.where("__rows > 1 OR NOT __kept").select(F.col("doc_id").alias("__id"), "__kept"), "minhash-odd")
    gone, repeated = _bounded(odd.where("NOT __kept")), _bounded(odd.where("__kept"))
    kept = docs.join(gone, docs["doc_id"] == F.col("__id"), "left_anti")
    once = kept.join(repeated, kept["doc_id"] == F.col("__id"), "left_anti")
    more = kept.join(repeated, kept["doc_id"] == F.col("__id"), "left_semi")
    return once.unionByName(more.dropDuplicates(["doc_id"]))
