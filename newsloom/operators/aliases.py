"""Aliases from a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.translit import resolve_aliases
from newsloom.operators.scale import checked_broadcast, collect_lookup

BLOCK = 512  # characters searched at once: substring counts from the start of its text
COMPILE_LIMIT = 500


def alias_keys(aliases: DataFrame) -> DataFrame:
    """``key, canonical``: one row per lower-cased alias; of several canonical
    forms the greatest. Empty aliases and nulls match nothing."""
    keys = aliases.select(F.lower("alias").alias("key"), F.coalesce("canonical", F.lit("")).alias("canonical"))
    return keys.where(F.col("key") != "").groupBy("key").agg(F.max("canonical").alias("canonical"))


def resolve_from_table(
    rows: DataFrame, text: str, aliases: DataFrame, out: str = "resolved", whole_words: bool = False, compile_limit: int = COMPILE_LIMIT,
) -> DataFrame:
    """``rows`` with the text lower-cased and its aliases replaced in column
    ``out``: from left to right, the longest alias first, none inside another
    and none replaced again. ``aliases``: ``alias, canonical``.

    Up to ``compile_limit`` aliases become one pattern. More are joined: at every
    position the first characters of a distinct text are looked up among the
    first characters of the aliases, which gives the lengths worth a try there,
    and pieces of those lengths are joined with the aliases themselves. Both
    joins are exact, so aliases with one common beginning form no group. Both
    ways give the same rows; a null text stays null."""
    keys = alias_keys(aliases)
    if keys.limit(compile_limit + 1).count() <= compile_limit:
        table = {r["key"]: r["canonical"] for r in collect_lookup(keys, compile_limit)}
        return rows.withColumn(out, resolve_aliases(F.col(text), table, whole_words))
    named = rows.withColumn("__lower", F.lower(text)).withColumn("__id", F.md5("__lower"))
    texts = named.where(F.col("__id").isNotNull()).groupBy("__id").agg(F.first("__lower").alias("__text"))
    replaced = texts.join(_matches(texts, keys, whole_words), "__id").select("__id", _replaced(F.col("__text"), F.col("found")).alias("__new"))
    return named.join(replaced, "__id", "left").withColumn(out, F.coalesce("__new", "__lower")).drop("__id", "__lower", "__new")


def _is_word(character: Column) -> Column:
    return F.rlike(character, F.lit(r"(?U)^\w$"))


def _matches(texts: DataFrame, keys: DataFrame, whole_words: bool) -> DataFrame:
    """``__id, found``: the longest alias at each position of a text, by position:
    ``start`` (from 0), ``size``, ``canonical``."""
    extent = keys.agg(F.min(F.length("key")).alias("least"), F.max(F.length("key")).alias("most")).first()
    width, most = min(3, extent["least"]), extent["most"]
    heads = keys.groupBy(F.substring("key", 1, width).alias("__head")).agg(F.collect_set(F.length("key")).alias("__sizes"))
    # A blank at either end: what stands beside a match, itself in none.
    padded = F.concat(F.lit(" "), F.col("__text"), F.lit(" "))
    numbers = F.sequence(F.lit(0), F.floor((F.length("__text") - 1) / BLOCK).cast("int"))
    blocks = texts.where(F.length("__text") >= width).select(
        "__id", F.posexplode(F.transform(numbers, lambda i: F.substring(padded, i * BLOCK + 1, F.lit(BLOCK + most + 2)))).alias("__block", "__part"))
    spots = F.transform(
        F.sequence(F.lit(1), F.least(F.length("__part") - 2, F.lit(BLOCK))),
        lambda k: F.struct(
            k.alias("k"), F.substring(F.col("__part"), k, F.lit(1)).alias("before"), F.substring(F.col("__part"), k + 1, F.lit(most + 1)).alias("piece")))
    pieces = blocks.select("__id", "__block", F.explode(spots).alias("s")).select(
        "__id", (F.col("__block") * BLOCK + F.col("s.k") - 1).alias("start"), F.col("s.before").alias("before"), F.col("s.piece").alias("piece"),
        F.substring("s.piece", 1, width).alias("__head"))
    tried = pieces.join(checked_broadcast(heads), "__head").select("__id", "start", "before", "piece", F.explode("__sizes").alias("size"))
    tried = tried.withColumn("key", F.substring(F.col("piece"), F.lit(1), F.col("size"))).where(F.length("piece") > F.col("size"))
    if whole_words:
        first, last = F.substring("key", 1, 1), F.substring("key", -1, 1)
        after = F.substring(F.col("piece"), F.col("size") + 1, F.lit(1))
        tried = tried.where((_is_word(F.col("before")) != _is_word(first)) & (_is_word(last) != _is_word(after)))
    hits = tried.select("__id", "start", "size", "key").join(checked_broadcast(keys), "key")
    longest = hits.groupBy("__id", "start").agg(F.max(F.struct("size", "canonical")).alias("m"))
    return longest.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("start", "m.size", "m.canonical"))).alias("found"))


def _replaced(text: Column, found: Column) -> Column:
    """The text with the matches that do not overlap an earlier one replaced."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<from:int,start:int,canonical:string>>").alias("kept"))
    folded = F.aggregate(
        found, start,
        lambda s, m: F.when(m["start"] < s["end"], s).otherwise(F.struct(
            (m["start"] + m["size"]).alias("end"),
            F.array_append(s["kept"], F.struct(s["end"].alias("from"), m["start"].alias("start"), m["canonical"].alias("canonical"))).alias("kept"))))
    parts = F.transform(folded["kept"], lambda m: F.concat(F.substring(text, m["from"] + 1, m["start"] - m["from"]), m["canonical"]))
    return F.concat(F.array_join(parts, ""), F.substring(text, folded["end"] + 1, F.length(text)))
