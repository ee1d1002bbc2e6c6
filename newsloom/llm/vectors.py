"""Near-duplicate vectors by int8 tile products with error bounds.

Equal vectors of a label become one class with a count of copies. Classes are
dealt to cells (the nearest of a few pivots) and cells to tiles of bounded
size. A vector goes to a pair of tiles only if the triangle inequality on
angles allows a link there. In a pair of tiles the vectors are quantised to
int8; the product of the codes differs from the cosine by no more than
``e_u + e_v + e_u e_v``, where ``e`` is the length of a vector's quantisation
error. Pairs that may reach the threshold are recomputed in double precision.

A task returns what it found in rows bounded by its vectors, not its pairs: the
number of links per vector, and a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import map_rows, stage
from newsloom.llm.components import components

TILE = 1024
PER_PIVOT = 8192
MAX_PIVOTS = 1024
SLACK = 1e-6  # of the bounds, for rounding


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and error length per row of unit vectors."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine of at least ``threshold``, for raw vectors."""
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    code_a, scale_a, error_a = quantise(a / norm_a[:, None])
    code_b, scale_b, error_b = quantise(b / norm_b[:, None])
    # Sums of int8 products are whole numbers; float32 holds them exactly up to
    # 2 ** 24, that is for 1,000 components, and float64 for all others.
    kind = np.float32 if a.shape[1] <= 1000 else np.float64
    rough = (code_a.astype(kind) @ code_b.astype(kind).T) * scale_a[:, None] * scale_b[None, :]
    bound = error_a[:, None] + error_b[None, :] + error_a[:, None] * error_b[None, :] + SLACK
    i, j = np.nonzero(rough + bound >= threshold)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 200_000):
        x, y = i[k : k + 200_000], j[k : k + 200_000]
        keep[k : k + 200_000] = np.einsum("ij,ij->i", a[x], b[y]) / (norm_a[x] * norm_b[y]) >= threshold
    return i[keep], j[keep]


def _forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges that keep the components of the pairs, at most one per node."""
    parent: dict[int, int] = {}

    def find(n: int) -> int:
        while parent.setdefault(n, n) != n:
            parent[n] = n = parent[parent[n]]
        return n

    out = []
    for a, b in zip(x.tolist(), y.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((min(a, b), max(a, b)))
    return out


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(x.as_py() for x in values), np.float64).reshape(len(values), -1) if len(values) else np.empty((0, 1))


def prepared(vectors: DataFrame) -> DataFrame:
    """Staged ``vec_id, label, size, raw, fp``; ``raw`` (doubles) and ``fp`` are
    null for vectors that link with nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            labels, column = batch.column("label"), batch.column("embedding")
            raw, prints, sizes = [], [], []
            for k in range(batch.num_rows):
                value, data = column[k], None
                if value.is_valid and labels[k].is_valid and len(value.values) and value.values.null_count == 0:
                    x = value.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    top = np.abs(x).max()
                    if np.isfinite(x).all() and top > 0:
                        # Far from 1 the squares could overflow; a power of two changes no cosine.
                        data = np.ldexp(x, -int(np.frexp(top)[1])) if not 1e-100 < top < 1e100 else x
                raw.append(None if data is None else data.tobytes())
                sizes.append(None if data is None else len(data))
                prints.append(None if data is None else xxhash.xxh3_128_digest(raw[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), labels, pa.array(sizes, pa.int32()), pa.array(raw, pa.binary()), pa.array(prints, pa.binary())],
                names=["vec_id", "label", "size", "raw", "fp"])

    picked = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("string"))
    return stage(map_rows(picked, read, "vec_id bigint, label string, size int, raw binary, fp binary"), "vectors")


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def tile_rows(classes: DataFrame, threshold: float, tile: int, per_pivot: int, max_pivots: int) -> DataFrame:
    """The rows of ``classes`` with the pairs of tiles they take part in:
    ``label, size, lo, hi, side`` (0 in ``lo``, 1 in ``hi``)."""
    wanted = max(1, min(max_pivots, classes.count() // per_pivot))
    chosen: dict[int, list] = {}  # at most max_pivots vectors for each length
    top = classes.withColumn("__rank", F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("rep"), "rep"))).where(F.col("__rank") <= wanted)
    for r in top.select("size", "raw", "rep").orderBy("rep").collect():
        x = np.frombuffer(bytes(r["raw"]), np.float64)
        chosen.setdefault(r["size"], []).append(x / np.linalg.norm(x))
    pivots = {n: np.stack(rows) for n, rows in chosen.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, angles = [], []
            for raw, n in zip(batch.column("raw"), batch.column("size").to_pylist()):
                x = np.frombuffer(raw.as_py(), np.float64)
                near = _angles((x / np.linalg.norm(x))[None], pivots[n])[0]
                cells.append(int(near.argmin()))
                angles.append(float(near.min()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array(angles, pa.float64())], names=[*batch.schema.names, "cell", "angle"])

    kind = classes.schema.simpleString().removeprefix("struct<").removesuffix(">")
    placed = stage(map_rows(classes, place, f"{kind}, cell int, angle double"), "vector-cells")
    cells = placed.groupBy("label", "size", "cell").agg(F.max("angle").alias("radius"), F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    by_label = stage(cells.groupBy("label", "size").agg(F.collect_list(F.struct("cell", "radius", "tiles")).alias("cells")), "vector-radii")  # max_pivots at most
    reach = float(np.arccos(threshold)) + SLACK

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, low, high, side = [], [], [], []
            for k in range(batch.num_rows):
                raw, n, own, rep = (batch.column(c)[k].as_py() for c in ("raw", "size", "cell", "rep"))
                x = np.frombuffer(raw, np.float64)
                near = _angles((x / np.linalg.norm(x))[None], pivots[n])[0]
                cells = batch.column("cells")[k].as_py()
                mine = (own, rep % next(c["tiles"] for c in cells if c["cell"] == own))
                for c in cells:
                    if c["cell"] != own and near[c["cell"]] > c["radius"] + reach:
                        continue
                    for part in range(c["tiles"]):
                        other = (c["cell"], part)
                        take.append(k)
                        low.append("{}.{}".format(*min(mine, other)))
                        high.append("{}.{}".format(*max(mine, other)))
                        side.append(int(mine > other))
            index = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(index) for c in ("label", "size", "rep", "copies", "raw")], pa.array(low, pa.string()), pa.array(high, pa.string()), pa.array(side, pa.int32())],
                names=["label", "size", "rep", "copies", "raw", "lo", "hi", "side"])

    dealt = placed.join(by_label, ["label", "size"])
    return map_rows(dealt, deal, "label string, size int, rep bigint, copies bigint, raw binary, lo string, hi string, side int")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, tile: int = TILE, per_pivot: int = PER_PIVOT, max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors``
    (``vec_id, embedding, label``; other columns are ignored).

    Null, empty, zero and not finite vectors and those without a label link
    with nothing, nor do vectors of different length. A repeated row is a
    vector of its own with the same id. A row without an id counts as a link
    of its copies but has no component and is kept. An empty table gives an
    empty result."""
    known = prepared(vectors)
    keyed = known.where("fp IS NOT NULL")
    classes = keyed.groupBy("label", "size", "fp").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw"))
    classes = stage(classes.where("rep IS NOT NULL").select("label", "size", "fp", "rep", "copies", "raw"), "vector-classes")
    tiles = tile_rows(classes.drop("fp"), threshold, tile, per_pivot, max_pivots)

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        raw, ids, copies = _matrix(table["raw"]), table["rep"].to_numpy(), table["copies"].to_numpy()
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if table["lo"][0] == table["hi"][0]:
            i, j = linked(raw, raw, threshold)
            i, j = i[i < j], j[i < j]
        elif len(one) and len(two):
            i, j = linked(raw[one], raw[two], threshold)
            i, j = one[i], two[j]
        else:
            i = j = np.empty(0, np.int64)
        found = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        with_links = np.flatnonzero(found)
        forest = _forest(ids[i], ids[j])
        return pa.table({
            "rep": pa.array([*ids[with_links], *[a for a, _ in forest]], pa.int64()),
            "links": pa.array([*found[with_links].astype(np.int64), *[None] * len(forest)], pa.int64()),
            "other": pa.array([*[None] * len(with_links), *[b for _, b in forest]], pa.int64()),
        })

    found = stage(tiles.groupBy("label", "size", "lo", "hi").applyInArrow(compare, "rep bigint, links bigint, other bigint"), "vector-links")
    counts = found.where("links IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    out = (
        classes.select("label", "size", "fp", "rep", "copies")
        .join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .where("copies > 1 OR links IS NOT NULL")
        .select("label", "size", "fp", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    joined = known.select("vec_id", "label", "size", "fp").join(stage(out, "vector-result"), ["label", "size", "fp"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
