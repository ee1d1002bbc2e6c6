"""Order-dependent operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.scale import BUCKET_WIDTH, carry_last, id_bucket, number_rows, top_per_group

# Fixed values of the day-boundary rules.
RESTART_DROP, LATE_FROM = 5, "21:00"
EARLY_BEFORE, CARRY_ABOVE, CARRY_STEPS = "02:00", 3, (1, 2)

GAP_RUN = 10_000  # missing numbers made in one row at most


def source_index(events: DataFrame, keys: Sequence[str] = ("date", "category"), width: int = BUCKET_WIDTH) -> DataFrame:
    """0-based position of an event inside its day and category, by id."""
    return number_rows(events, list(keys), ["id"], [id_bucket("id", width)], "src_idx")


def related_events(events: DataFrame, k: int = 3) -> DataFrame:
    """For every event the ``k`` latest other events of its day.

    The ``k + 1`` latest events of a day contain the answer for all its events,
    so no pairs inside a day are formed: the short list is joined once per day
    and the event itself is taken out."""
    latest = top_per_group(
        events.select("date", "id", "time"), ["date"], [F.desc_nulls_last("time"), F.asc("id")], k + 1, "__r"
    )
    lists = latest.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("__r", "id", "time"))).alias("__l"))
    others = F.slice(F.filter("__l", lambda x: x["id"] != F.col("id")), 1, k)
    return (
        events.select("date", "id").join(F.broadcast(lists), "date")
        .select("id", F.posexplode(others).alias("rank", "__o"))
        .select("id", (F.col("rank") + 1).alias("rank"), F.col("__o.id").alias("related_id"))
    )


def prev_next(days: DataFrame, column: str = "date") -> DataFrame:
    """Previous and next present day (or month) and its place in the row.
    The input has one row per calendar period, which bounds the single window."""
    window = Window.partitionBy(F.lit(1)).orderBy(column)
    whole = Window.partitionBy(F.lit(1))
    return days.select(
        column, F.lag(column).over(window).alias("previous"), F.lead(column).over(window).alias("next"),
        F.row_number().over(window).alias("number"), F.count(F.lit(1)).over(whole).alias("of"),
    )


def month_trend(months: DataFrame, total: str = "total", limit: int = 30) -> DataFrame:
    """E5: change against the previous present month in percent, half-even."""
    before = F.lag(total).over(Window.partitionBy(F.lit(1)).orderBy("month"))
    change = F.when(before > 0, F.bround((F.col(total) - before) / before * 100, 0).cast("long"))
    return months.withColumn("change", change).withColumn(
        "trend", F.when(F.col("change") >= limit, "up").when(F.col("change") <= -limit, "down").otherwise("none")
    )


def top_days_in_order(reports: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` largest days of each month, put back into date order."""
    month = F.trunc("date", "MM")
    top = top_per_group(reports.withColumn("month", month), ["month"], [F.desc("total"), F.asc("date")], k, "__r")
    return top.drop("__r").withColumn("number", F.row_number().over(Window.partitionBy("month").orderBy("date")))


def below_period_mean(days: DataFrame, limit: float = 0.5, high: Column | None = None) -> DataFrame:
    """Days (``date, n``) below a share of their month's mean; confidence is
    high where ``high`` holds. One row per day goes in."""
    mean = F.avg("n").over(Window.partitionBy(F.trunc("date", "MM")))
    marked = days.withColumn("month_mean", mean).withColumn("suspect", F.col("n") < limit * F.col("month_mean"))
    if high is not None:
        marked = marked.withColumn("confidence", F.when(F.col("suspect"), F.when(high, "high").otherwise("low")))
    return marked


def trailing_median(days: DataFrame, span: int = 7, limit: float = 0.5) -> DataFrame:
    """Days below a share of the median of the preceding ``span`` days."""
    window = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(-span, -1)
    return days.withColumn("median", F.percentile("n", F.lit(0.5)).over(window)).withColumn(
        "repull", F.coalesce(F.col("n") < limit * F.col("median"), F.lit(False))
    )


def per_group_cap(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None = None) -> DataFrame:
    """The rows of each group with their rank; a report passes the number
    ``k`` of rows that it shows per group."""
    if k is None:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return top_per_group(rows, keys, order, k)


def sequence_gaps(rows: DataFrame, keys: Sequence[str], number: str, width: int = BUCKET_WIDTH) -> DataFrame:
    """Numbers missing from 1..max of each group, one row per number, from
    the gaps of ``sequence_gap_ranges``, in runs of at most ``GAP_RUN``."""
    gaps = sequence_gap_ranges(rows, keys, number, width)
    runs = gaps.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - F.col("first")) / GAP_RUN))).alias("__run"))
    start = F.col("first") + F.col("__run") * GAP_RUN
    missing = F.sequence(start, F.least(F.col("last"), start + (GAP_RUN - 1)))
    return runs.select(*keys, F.explode(missing).alias("missing")).withColumn("missing", F.col("missing").cast(rows.schema[number].dataType))


def sequence_gap_ranges(rows: DataFrame, keys: Sequence[str], number: str, width: int = BUCKET_WIDTH) -> DataFrame:
    """``first, last`` of each gap in 1..max of a group: one row per gap,
    however large a number is.

    Distinct numbers are compared with their predecessor only, so a group is
    never collected."""
    present = rows.where(F.col(number) >= 1).select(*keys, number).distinct()
    carried = carry_last(present, list(keys), [number], [id_bucket(number, width)], F.col(number), "__prev")
    before = F.coalesce("__prev", F.lit(0)).cast("long")
    gaps = carried.select(*keys, (before + 1).alias("first"), (F.col(number).cast("long") - 1).alias("last"))
    return gaps.where("first <= last")


def out_of_range(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Numbers outside 1..max, that is below 1 (0 means unnumbered)."""
    return rows.where(F.col(number) < 0).select(*keys, F.col(number).alias("extra")).distinct()


# -- day boundaries (E2, E3, C8) -------------------------------------------------
# The decisions below are one row per calendar day; that bound is why they are
# broadcast to the rows, which then move without a shuffle.


def _numbered() -> Column:
    return F.when((F.coalesce("badge", F.lit("")) != "communique") & (F.col("num") > 0), F.col("num"))


def day_restarts(rows: DataFrame, width: int = BUCKET_WIDTH) -> DataFrame:
    """Per day the last row whose number falls ``RESTART_DROP`` or more below the
    nearest earlier number: ``date, restart`` (null if none). Input:
    ``date, position, num, time, badge``."""
    carried = carry_last(rows, ["date"], ["position"], [id_bucket("position", width)], _numbered(), "__prev")
    return carried.groupBy("date").agg(
        F.max(F.when(F.col("__prev") - _numbered() >= RESTART_DROP, F.col("position"))).alias("restart")
    )


def restart_cuts(rows: DataFrame, width: int = BUCKET_WIDTH) -> DataFrame:
    """E2 decisions: ``date, cut``, the position from which a day's rows belong
    to the next day. Only days that are cut are listed.

    Days are reduced to one summary row each. A day that takes over the tail of
    the day before may get its own restart from that; the chain is followed
    through the day summaries (one row per calendar day) in date order, exactly
    as a day-by-day walk would.
    """
    base = rows.select("date", "position", "num", "time", "badge")
    late = (F.coalesce("time", F.lit("00:00")) >= LATE_FROM) | (F.coalesce("num", F.lit(0)) <= 0)
    numbered = _numbered()
    firsts = base.groupBy("date").agg(
        F.min(F.when(numbered.isNotNull(), F.col("position"))).alias("first_pos"),
        F.min_by("num", F.when(numbered.isNotNull(), F.col("position"))).alias("first_num"),
        F.max(F.when(~late, F.col("position"))).alias("last_early"),
        F.max_by("num", F.when(numbered.isNotNull(), F.col("position"))).alias("last_num"),
    )
    days = firsts.join(day_restarts(base, width), "date")
    # Own restart: the tail moves if no early numbered row is in it. Otherwise
    # a tail received from the day before can create one at the first number.
    last_early = F.coalesce("last_early", F.lit(-1))
    summary = days.select(
        "date", "restart", "first_pos", "first_num", "last_num",
        (F.col("restart").isNotNull() & (last_early < F.col("restart"))).alias("own_move"),
        (last_early < F.col("first_pos")).alias("first_late"),
    )
    return _walk_restarts(summary)


def apply_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with ``moved`` and ``new_date`` from the cuts of ``restart_cuts``."""
    return (
        rows.join(F.broadcast(cuts), "date", "left")
        .withColumn("moved", F.coalesce(F.col("position") >= F.col("cut"), F.lit(False)))
        .withColumn("new_date", F.when(F.col("moved"), F.date_add("date", 1)).otherwise(F.col("date")))
        .drop("cut")
    )


def sequence_restart(rows: DataFrame, width: int = BUCKET_WIDTH) -> DataFrame:
    """Every row with ``moved`` = whether it belongs to the next day."""
    return apply_cuts(rows, restart_cuts(rows, width))


def _walk_restarts(summary: DataFrame) -> DataFrame:
    """Fold over the day summaries of each run of consecutive days."""
    entry = F.struct("date", "restart", "first_pos", "first_num", "last_num", "own_move", "first_late")
    start = F.struct(
        F.lit(None).cast("int").alias("carried"),
        F.array().cast("array<struct<date:date,cut:bigint>>").alias("cuts"),
    )

    def step(acc: Column, day: Column) -> Column:
        chained = day["restart"].isNull() & (acc["carried"] - day["first_num"] >= RESTART_DROP) & day["first_late"]
        cut = F.when(F.coalesce(day["own_move"], F.lit(False)), day["restart"]).when(chained, day["first_pos"])
        return F.struct(
            F.when(cut.isNotNull(), day["last_num"]).cast("int").alias("carried"),
            F.concat(acc["cuts"], F.array(F.struct(day["date"].alias("date"), cut.cast("bigint").alias("cut")))).alias("cuts"),
        )

    return _day_runs(summary, entry).select(F.inline(F.aggregate("days", start, step)["cuts"])).where(F.col("cut").isNotNull())


def carry_heads(rows: DataFrame) -> DataFrame:
    """E3, C8 decisions: ``date, head``, the first row of a day that belongs to
    the previous calendar day: it is early, has a number above ``CARRY_ABOVE``
    and continues the number of the previous day's last row.

    Only the first and last row of each day take part, so the days are compared,
    not the rows. A day whose only row moved away gives no last row to the day
    after it; such chains are followed over the day summaries.
    """
    ends = rows.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("first_pos"),
        F.min_by("num", "position").alias("first_num"), F.min_by("time", "position").alias("first_time"),
        F.max_by("num", "position").alias("last_num"),
    )
    entry = F.struct(
        "date", "n", "first_pos", F.coalesce("first_num", F.lit(0)).alias("num"),
        F.coalesce("first_time", F.lit("23:59")).alias("time"), F.coalesce("last_num", F.lit(0)).alias("last_num"),
    )
    start = F.struct(
        F.lit(None).cast("int").alias("last"), F.array().cast("array<struct<date:date,head:bigint>>").alias("heads")
    )

    def step(acc: Column, day: Column) -> Column:
        follows = (day["num"] - acc["last"]).isin(*CARRY_STEPS)
        moves = F.coalesce((day["time"] < EARLY_BEFORE) & (day["num"] > CARRY_ABOVE) & follows, F.lit(False))
        head = F.array(F.struct(day["date"].alias("date"), day["first_pos"].cast("bigint").alias("head")))
        return F.struct(
            F.when(~(moves & (day["n"] == 1)), day["last_num"]).cast("int").alias("last"),
            F.when(moves, F.concat(acc["heads"], head)).otherwise(acc["heads"]).alias("heads"),
        )

    return _day_runs(ends, entry).select(F.inline(F.aggregate("days", start, step)["heads"]))


def apply_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows with ``moved`` and ``new_date`` from the heads of ``carry_heads``."""
    return (
        rows.join(F.broadcast(heads), "date", "left")
        .withColumn("moved", F.coalesce(F.col("position") == F.col("head"), F.lit(False)))
        .withColumn("new_date", F.when(F.col("moved"), F.date_sub("date", 1)).otherwise(F.col("date")))
        .drop("head")
    )


def sequence_carry_back(rows: DataFrame) -> DataFrame:
    """Every row with ``moved`` = whether it belongs to the day before."""
    return apply_heads(rows, carry_heads(rows))


def _day_runs(days: DataFrame, entry: Column) -> DataFrame:
    """One row per run of consecutive days with its day summaries in order. A
    run holds one small struct per calendar day."""
    window = Window.partitionBy(F.lit(1)).orderBy("date")
    broken = F.coalesce(F.datediff("date", F.lag("date").over(window)) != 1, F.lit(True))
    runs = days.withColumn("__b", broken.cast("int")).withColumn("run", F.sum("__b").over(window))
    return runs.groupBy("run").agg(F.array_sort(F.collect_list(entry)).alias("days"))
