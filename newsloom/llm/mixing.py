"""Mixing sources to target weights by Pareto order sampling. DataFrame only.

Every source gets a target in words; a level of repetition is filled up until
no target is above its cap. Inside a source the expected copies of a document
fall slowly with its length (``damping``), so that a few huge documents do not
carry a source; they never exceed the cap either. The whole part of the
expectation is allotted as certain copies. The fraction is an inclusion
probability p: documents are ranked by the odds of a uniform number divided by
the odds of p (Pareto order sampling) and taken in this order until the source
has the words it lacks: a sample of fixed size, in words.

Numbers come from a hash of id and size, so reruns agree. Ranking a source
never sorts the source: words are summed per slice of the rank, the slice in
which the target is reached is found on these sums, and only that slice is
ordered, equal rows as one with their number. Where the target ends among rows of
equal id and size, as many of them are taken as come nearest to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import SPACE_CLASS, stage, whole
from newsloom.operators.scale import number_rows

SLICES = 1 << 14


def word_count(text: Column) -> Column:
    """Number of words without building them: word starts are counted."""
    spaced = F.regexp_replace(whole(text), SPACE_CLASS + "+", " ")
    return F.when(F.trim(spaced) == "", F.lit(0)).otherwise(
        F.length(F.trim(spaced)) - F.length(F.translate(F.trim(spaced), " ", "")) + 1
    ).cast("long")


def fill(parts: DataFrame, group: Sequence[str], weight: str, cap: str, total: Column, out: str) -> DataFrame:
    """``out = min(cap, level * weight)`` with one level per group such that the
    sum is ``total``, or all caps if they sum to less. Closed form: with parts
    ordered by cap/weight the capped ones are a prefix."""
    order = Window.partitionBy(*[F.col(g) for g in group] or [F.lit(0)]).orderBy(F.col(cap) / F.col(weight), *parts.columns)
    everything = Window.partitionBy(*[F.col(g) for g in group] or [F.lit(0)])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum(F.col(cap).cast("double")).over(before), F.lit(0.0))
    rest = F.sum(F.col(weight).cast("double")).over(everything) - F.coalesce(F.sum(F.col(weight).cast("double")).over(before), F.lit(0.0))
    tried = parts.withColumns({"__rank": F.row_number().over(order), "__level": (total - capped) / F.greatest(rest, F.col(weight).cast("double"))})
    fits = F.col("__level") * F.col(weight) <= F.col(cap)
    first = F.min(F.when(fits, F.struct("__rank", "__level"))).over(everything)
    return tried.withColumn("__first", first["__level"]).withColumn(
        out, F.when(F.col("__first").isNull(), F.col(cap).cast("double"))
        .otherwise(F.least(F.col(cap).cast("double"), F.col("__first") * F.col(weight)))
    ).drop("__rank", "__level", "__first")


def _uniform(doc_id: str, size: str, seed: int) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(size).cast("long")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def size_class(size: str = "size") -> Column:
    """Number of binary digits of the size; 0 for an empty document."""
    return F.when(F.col(size) > 0, F.length(F.bin(size))).otherwise(0)


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` (words), staged: texts are read once."""
    return stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def mixing_plan(
    sizes: DataFrame, cycle: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
    damping: float = 0.125, seed: int = 20, slices: int = SLICES,
) -> DataFrame:
    """One row per (source, size class): ``source_size, target, rate`` (expected
    copies) and the cut of the source: ``slice`` and, inside it, ``last``: the key
    ``(rank, doc_id, size)`` where the target ends, with the number of rows that
    have it (``among``) and of those taken (``ties``). At most 64 rows per source."""
    classes = stage(
        sizes.groupBy("source", size_class().alias("klass")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")),
        "mix-classes",
    )
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    kinds = F.array(*[F.lit(float(w)) for w in cycle])
    weighed = sources.withColumns({
        "__weight": F.element_at(kinds, (F.pmod(number, F.lit(len(cycle))) + 1).cast("int")),
        "__cap": F.col("source_size") * cap,
        "__total": F.sum("source_size").over(Window.partitionBy(F.lit(0))) * share,
    })
    targets = fill(weighed, [], "__weight", "__cap", F.col("__total"), "target").select("source", "source_size", "target")

    slowed = F.pow(F.lit(2.0), -F.lit(damping) * F.col("klass"))
    classed = classes.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    classed = classed.withColumns({"__pull": slowed * F.col("words"), "__cap": F.col("words") * cap})
    full = classed.where(F.col("words") > 0)
    rates = fill(full, ["source"], "__pull", "__cap", F.col("target"), "__words").withColumn("rate", F.col("__words") / F.col("words"))
    empty = classed.where(F.col("words") == 0).withColumn("rate", F.least(F.lit(float(cap)), F.coalesce(F.col("target") / F.col("source_size"), F.lit(0.0))))
    plan = rates.select("source", "klass", "source_size", "target", "words", "rate").unionByName(
        empty.select("source", "klass", "source_size", "target", "words", "rate"))
    # A rate that is whole but for rounding counts as whole.
    plan = stage(plan.withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate"))), "mix-plan")

    lacking = plan.groupBy("source").agg(
        (F.first("target") - F.sum(F.floor("rate") * F.col("words"))).alias("lack"))
    ranked = with_rank(sizes, plan, seed, slices).where("__p > 0")
    by_slice = ranked.groupBy("source", "__slice").agg(F.sum("size").alias("__w"))
    running = Window.partitionBy("source").orderBy("__slice")
    cum = by_slice.withColumn("__upto", F.sum("__w").over(running))
    reached = cum.join(lacking.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    slice_cut = stage(
        reached.where("__upto >= lack").groupBy("source", "lack").agg(F.min(F.struct("__slice", (F.col("__upto") - F.col("__w")).alias("before"))).alias("__c"))
        .select(F.col("source").alias("cut_source"), F.col("__c.__slice").alias("slice"), (F.col("lack") - F.col("__c.before")).alias("open")),
        "mix-slices",
    )
    at_cut = ranked.join(slice_cut, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("__slice") == F.col("slice")))
    equal = at_cut.groupBy("source", "open", "__rank", "doc_id", "size").agg(F.count(F.lit(1)).alias("among"))
    inside = Window.partitionBy("source").orderBy("__rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("among") * F.col("size")
    key = F.struct(F.col("__rank").alias("rank"), "doc_id", "size")
    nearest = F.floor(F.try_divide(F.col("open") - F.col("before"), F.col("size")) + 0.5)
    ties = F.least(F.col("among"), F.greatest(F.coalesce(nearest, F.lit(0)), F.lit(0))).cast("long")
    last = (
        equal.withColumn("before", F.coalesce(F.sum(words).over(inside), F.lit(0)))
        .where(F.col("before") + words >= F.col("open"))
        .groupBy("source").agg(F.min(F.struct(key.alias("last"), "among", ties.alias("ties"))).alias("__l"))
        .select(F.col("source").alias("last_source"), "__l.*")
    )
    cuts = slice_cut.join(last, F.col("cut_source").eqNullSafe(F.col("last_source")), "left").select("cut_source", "slice", "last", "among", "ties")
    out = plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return stage(out.select("source", "klass", "source_size", "target", "rate", "slice", "last", "among", "ties"), "mix-cuts")


def with_rank(sizes: DataFrame, plan: DataFrame, seed: int, slices: int) -> DataFrame:
    """Rows with their expected copies, rank in (0, 1) and slice of the rank.
    The plan is a staged table of a few rows per source: Spark broadcasts it if
    its size allows, and joins by shuffle otherwise."""
    p = plan.select(*[F.col(c).alias(f"__plan_{c}") for c in plan.columns])
    joined = sizes.withColumn("__klass", size_class()).join(
        p, F.col("source").eqNullSafe(F.col("__plan_source")) & (F.col("__klass") == F.col("__plan_klass")))
    u = _uniform("doc_id", "size", seed)
    odds = u / (1 - u) * (1 - F.col("__p")) / F.nullif(F.col("__p"), F.lit(0.0))
    return (
        joined.withColumn("__p", F.col("__plan_rate") - F.floor("__plan_rate"))
        .withColumn("__rank", F.when(F.col("__p") > 0, odds / (1 + odds)))
        .withColumn("__slice", F.least(F.floor(F.col("__rank") * slices), F.lit(slices - 1)).cast("int"))
    )


def copies(sizes: DataFrame, plan: DataFrame, seed: int = 20, slices: int = SLICES) -> DataFrame:
    """``sizes`` with ``source_size, target, copies``: a narrow decision once
    the plan is known. ``sizes`` may hold more columns, which stay. Only rows
    that the plan takes in part, all equal, are staged and numbered."""
    ranked = with_rank(sizes, plan, seed, slices)
    key, last = F.struct(F.col("__rank").alias("rank"), "doc_id", "size"), F.col("__plan_last")
    inside = F.coalesce(key < last, F.lit(False)) | (key.eqNullSafe(last) & (F.col("__plan_ties") == F.col("__plan_among")))
    chosen = F.when(F.col("__p") > 0, F.when(F.col("__plan_slice").isNull(), True).otherwise(
        (F.col("__slice") < F.col("__plan_slice")) | ((F.col("__slice") == F.col("__plan_slice")) & inside)
    )).otherwise(False)
    part = F.coalesce((F.col("__p") > 0) & key.eqNullSafe(last) & F.col("__plan_ties").between(1, F.col("__plan_among") - 1), F.lit(False))

    def decided(rows: DataFrame, more: Column) -> DataFrame:
        return rows.select(
            *sizes.columns, F.col("__plan_source_size").alias("source_size"), F.col("__plan_target").alias("target"),
            (F.floor("__plan_rate") + more.cast("long")).alias("copies"))

    if plan.where(F.col("ties").between(1, F.col("among") - 1)).isEmpty():
        return decided(ranked, chosen)
    equal = stage(ranked.where(part).withColumn("__at", F.monotonically_increasing_id()), "mix-ties")
    numbered = number_rows(equal, ["source"], ["__at"], [F.shiftright("__at", 12)], "__number")
    return decided(ranked.where(~part), chosen).unionByName(decided(numbered, F.col("__number") < F.col("__plan_ties")))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` per row of
    ``docs`` (``doc_id, text, source``; further columns are ignored).

    Null or empty text: size 0. Null source: a source of its own, last in
    order. Rows of equal id and size share their rank; where the target ends
    among them, the first of them (as they are stored) are taken. A source ends
    within half a document of its target. An empty table gives an empty result."""
    sizes = sized(docs)
    seed, slices = settings.get("seed", 20), settings.get("slices", SLICES)
    return copies(sizes, mixing_plan(sizes, **settings), seed, slices).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the columns of ``docs``, every row as often as it is
    taken. Texts are not shuffled; decisions are recomputed beside them."""
    sizes = sized(docs)
    plan = mixing_plan(sizes, **settings)
    own = docs.select(
        F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.struct(*[F.col(c) for c in docs.columns]).alias("__row"))
    counted = copies(own, plan, settings.get("seed", 20), settings.get("slices", SLICES))
    repeated = counted.where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__n"))
    return repeated.select("__row.*")
