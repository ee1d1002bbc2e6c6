"""Building blocks that keep one hot key from becoming one hot task.

A day, a category or a place may hold a third of all rows. Numbering, carrying
values forward and collecting lists inside such a group are therefore done in
two steps: inside small *buckets* of the group in parallel, and across the
(few) buckets of the group on pre-aggregated rows.

A bucket is a coarse, order-preserving prefix of the ordering, for example
``floor(id / 65536)``; with unique ids it can never hold more rows than that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_WIDTH = 65_536
PART_SIZE = 10_000
TASK_ROWS = 20_000  # short texts: a second or two of extraction
TASK_BYTES = 4_000_000  # of dump files: about as many records


def id_bucket(column: str | Column, width: int = BUCKET_WIDTH) -> Column:
    """Order-preserving bucket of an integer key: its value rounded down."""
    col = (F.col(column) if isinstance(column, str) else column).cast("long")
    return col - F.pmod(col, F.lit(width).cast("long"))


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _with_heads(tagged: DataFrame, heads: DataFrame) -> DataFrame:
    """Put one head row in front of every bucket. Rows and heads meet in the
    one shuffle that the window over the bucket needs anyway; a join would add
    its own, and would need care with null keys."""
    body = tagged.withColumn("__head", F.lit(0))
    return body.unionByName(heads.withColumn("__head", F.lit(1)), allowMissingColumns=True)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Sequence[str | Column],
    out: str = "position",
    group_size: str | None = None,
) -> DataFrame:
    """0-based position of every row inside its group, in ``order``, and on
    request the size of the group.

    Equal to ``row_number() - 1`` over the whole group, but no task ever sorts
    more than one bucket. A narrow pre-pass counts the rows per bucket; the rows
    themselves are shuffled once.
    """
    tagged = df.withColumn("__bucket", F.struct(*_columns(bucket)))
    bucket_keys = [*keys, "__bucket"]
    sizes = tagged.groupBy(*bucket_keys).agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *bucket_keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
        *([F.sum("__n").over(group).alias("__size")] if group_size else []),
    )
    inside = Window.partitionBy(*bucket_keys).orderBy(F.desc("__head"), *_columns(order))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {out: F.first("__start").over(so_far) + F.row_number().over(inside) - 2}
    if group_size:
        added[group_size] = F.first("__size").over(so_far)
    return (
        _with_heads(tagged, starts).withColumns(added).where(F.col("__head") == 0)
        .drop("__bucket", "__start", "__size", "__head")
    )


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Sequence[str | Column],
    value: Column,
    out: str,
) -> DataFrame:
    """Last non-null ``value`` among the rows strictly before this one.

    The head row of a bucket holds the value carried in from earlier buckets."""
    tagged = df.withColumn("__bucket", F.struct(*_columns(bucket))).withColumn("__v", value)
    bucket_keys = [*keys, "__bucket"]
    columns = _columns(order)
    latest = columns[0] if len(columns) == 1 else F.struct(*columns)
    tails = tagged.groupBy(*bucket_keys).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), latest)).alias("__tail"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*bucket_keys, F.last("__tail", ignorenulls=True).over(before).alias("__v"))
    inside = Window.partitionBy(*bucket_keys).orderBy(F.desc("__head"), *_columns(order))
    return (
        _with_heads(tagged, carried)
        .withColumn(out, F.last("__v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.col("__head") == 0)
        .drop("__bucket", "__v", "__head")
    )


def collect_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Sequence[str | Column],
    item: Column,
    out: str = "items",
    part_size: int = PART_SIZE,
) -> DataFrame:
    """Ordered list per group, split into parts of at most ``part_size`` items,
    each with the size of the whole group.

    An ordinary group has exactly one part (``part`` = 0). A huge one becomes
    several rows, so nothing is dropped and no row grows without bound.
    """
    numbered = number_rows(df.withColumn("__item", item), keys, order, bucket, "__pos", "group_size")
    return (
        numbered.withColumn("part", F.floor(F.col("__pos") / F.lit(part_size)).cast("int"))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct("__pos", "__item"))).alias("__list"), F.first("group_size").alias("group_size"))
        .select(*keys, "part", F.transform("__list", lambda x: x["__item"]).alias(out), "group_size")
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group with their 1-based rank.

    The rank filter lets Spark keep only ``k`` rows per group in every map task
    before the shuffle (window group limit), so hot groups stay small.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


def checked_broadcast(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32_000_000) -> DataFrame:
    """Broadcast a lookup table only after measuring it, in rows and in bytes; a
    larger one is joined by shuffle and left to adaptive skew handling. At most
    ``max_rows + 1`` rows are read for that."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))))
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(size, F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found["n"] <= max_rows and found["size"] <= max_bytes else df


def spread(scan: DataFrame) -> DataFrame:
    """Re-deal a plain file scan for CPU-bound text work: over all cores, and at
    most about ``TASK_ROWS`` rows a task, so a larger table gives more tasks and
    not longer ones. The rows are counted from the footers of the files. A scan
    that has as many splits as that is returned as it is."""
    wanted = max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // TASK_ROWS))
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan


def spread_bytes(records: DataFrame, size: int) -> DataFrame:
    """The same for records out of files of ``size`` bytes, whose rows are not
    known before they are read: at most about ``TASK_BYTES`` a task."""
    wanted = max(records.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return records.repartition(wanted) if records.rdd.getNumPartitions() < wanted else records


def pin(df: DataFrame, **computed: Column) -> DataFrame:
    """Add columns behind a generator, so that filters and projections above
    use the computed values instead of re-evaluating the expressions."""
    fields = F.struct(*[expr.alias(name) for name, expr in computed.items()])
    return df.select("*", F.inline(F.array(fields)))


def collect_lookup(df: DataFrame, max_rows: int = 5_000) -> list:
    """Bring a small rule or alias table to the driver to compile it into
    expressions; refuse anything larger than the stated bound."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"lookup table has more than {max_rows} rows; join it instead of compiling it")
    return rows
