"""Places: gazetteers, substring geocoding, borders, points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.geo import haversine_km, vertex_centroid
from newsloom.functions.text import norm_match
from newsloom.operators.scale import BUCKET_WIDTH, PART_SIZE, checked_broadcast, collect_lookup, collect_parts, id_bucket
from newsloom.operators.sets import union_by_priority

COMPILE_LIMIT = 500


def load_gazetteer(*sources: DataFrame) -> DataFrame:
    """Places of several sources (``name, lat, lng, priority``), the first
    source that has a name wins."""
    return union_by_priority(sources, ["name"], keep="first")


def coords_by_day(points: DataFrame, keep: str = "last") -> DataFrame:
    """One coordinate per name over all days: the last or the first by
    (date, position)."""
    choose = F.max_by if keep == "last" else F.min_by
    named = points.where((F.trim("loc") != "") & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    order = F.struct("date", "position")
    return named.groupBy(F.trim("loc").alias("loc")).agg(
        choose("lat", order).alias("lat"), choose("lng", order).alias("lng")
    )


def _entries(gazetteer: DataFrame, mode: str, normalise: Callable[[Column], Column] | None) -> DataFrame:
    """Search keys with the order in which they are preferred (``rank_a``,
    ``rank_b`` ascending). If two names share a key, the later one gives the
    coordinates and the earlier one the place in the order."""
    key = normalise(F.col("name")) if normalise else F.col("name")
    keyed = gazetteer.select(key.alias("key"), "name", "lat", "lng", "priority").where(F.length("key") > 0)
    merged = keyed.groupBy("key").agg(
        F.max_by(F.struct("name", "lat", "lng"), "priority").alias("place"), F.min("priority").alias("first_priority")
    )
    length = -F.length("key") if mode == "longest" else F.lit(0)
    return merged.select(
        "key", "place.name", "place.lat", "place.lng", length.alias("rank_a"), F.col("first_priority").alias("rank_b")
    )


def geocode(
    rows: DataFrame, text: str, gazetteer: DataFrame, mode: str = "longest",
    normalise: Callable[[Column], Column] | None = None, compile_limit: int = COMPILE_LIMIT,
) -> DataFrame:
    """The best place whose name is a substring of the text; rows
    without a place are dropped. Adds ``place, lat, lng``.

    ``longest`` prefers the longest key (ties: earlier entry), ``first`` the
    earliest entry. A gazetteer of at most ``compile_limit`` keys is compiled
    into one literal array and searched in place, with no shuffle. A larger one
    is joined on the leading characters of the names: every position of a text
    gives one short gram, an equi join finds the candidates, and a substring
    test keeps the true ones. No pair of text and place is formed without a
    common gram, and each distinct text is searched once. Both ways give the
    same rows.
    """
    if normalise is None and mode == "longest":
        normalise = norm_match
    entries = _entries(gazetteer, mode, normalise)
    searched = rows.drop("place", "lat", "lng").withColumn("__text", normalise(F.col(text)) if normalise else F.col(text))
    if compile_limit and entries.limit(compile_limit + 1).count() <= compile_limit:
        found = _search_compiled(searched, collect_lookup(entries, compile_limit))
    else:
        found = _search_joined(searched, entries)
    return found.where(F.col("place").isNotNull()).drop("__text")


def _search_compiled(rows: DataFrame, entries: list) -> DataFrame:
    ordered = sorted(entries, key=lambda r: (r["rank_a"], r["rank_b"]))
    if not ordered:
        return rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("place", "string"), ("lat", "double"), ("lng", "double"))])
    table = F.array(
        *[F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in (("key", "string"), ("name", "string"), ("lat", "double"), ("lng", "double"))]) for r in ordered]
    )
    best = F.try_element_at(F.filter(table, lambda g: F.col("__text").contains(g["key"])), F.lit(1))
    return rows.select("*", F.inline_outer(F.array(F.struct(best["name"].alias("place"), best["lat"].alias("lat"), best["lng"].alias("lng")))))


def _search_joined(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """The places of the distinct texts, joined back on the text: rows may have
    any keys, also none or repeated ones."""
    shortest = entries.agg(F.min(F.length("key"))).first()[0] or 1
    width = min(3, shortest)
    grams = F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length("__text") - (width - 1)), lambda i: F.substring(F.col("__text"), i, F.lit(width)))
    )
    texts = rows.where(F.length("__text") >= width).select("__text").distinct()
    keyed = checked_broadcast(entries.withColumn("__gram", F.substring("key", 1, width)))
    candidates = texts.select("__text", F.explode(grams).alias("__gram")).join(keyed, "__gram").where(F.col("__text").contains(F.col("key")))
    best = candidates.groupBy("__text").agg(
        F.min_by(F.struct(F.col("name").alias("place"), "lat", "lng"), F.struct("rank_a", "rank_b", "name")).alias("__best")
    )
    return rows.join(best, "__text", "inner").select("*", "__best.*").drop("__best")


def alert_points(
    alerts: DataFrame, keys: Sequence[str] = ("date",), order: str = "position",
    part_size: int = PART_SIZE, width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Per place the count and the list of times in order of appearance.

    Input: geocoded alerts with ``place, lat, lng, time`` and a position. Times
    beyond ``part_size`` continue in further parts of the same place."""
    group = [*keys, "place", "lat", "lng"]
    entry = F.struct(F.col(order).alias("at"), F.col("time"))
    lists = collect_parts(alerts, group, [order], [id_bucket(order, width)], entry, "entries", part_size)
    return lists.select(
        *keys, F.col("place").alias("loc"), "lat", "lng", "part", F.transform("entries", lambda e: e["time"]).alias("times"),
        F.col("group_size").alias("count"), F.col("entries")[0]["at"].alias("first_position"),
    )


def place_type_sets(rows: DataFrame, type_column: str, place: str = "place") -> DataFrame:
    """Per place the count and its distinct types, sorted. The types are a
    short fixed vocabulary, so the sets stay small."""
    return rows.groupBy(place).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(type_column)).alias("types")
    )


def border_lookup(places: DataFrame, borders: DataFrame, name: str = "name", fallback: str = "marker") -> DataFrame:
    """C4: polygon by exact place name, else a marker."""
    shapes = checked_broadcast(borders.select(F.col(name), F.col("geojson")))
    return places.join(shapes, name, "left").withColumn(
        "shape", F.when(F.col("geojson").isNotNull(), F.lit("polygon")).otherwise(F.lit(fallback))
    )


def polygon_centroid(geojson: Column) -> Column:
    """J2 over ``struct<type, coordinates: array<array<array<array<double>>>>>``
    where a plain polygon is stored as a multi-polygon of one."""
    return vertex_centroid(F.flatten(geojson["coordinates"]))


def nearest_within(
    places: DataFrame, candidates: DataFrame, name: str = "name", limit_km: float = 20.0
) -> DataFrame:
    """Per place the nearest candidate of the same name within the limit.

    ``places``: ``name, lat, lng``; ``candidates``: ``name, candidate_id,
    c_lat, c_lng``. Both fall into cells about as wide as the limit; a candidate
    is put into the cells around it, so a frequent name is compared within
    neighbouring cells only. The minimum is kept per map task before the
    shuffle."""
    placed = places.withColumn("__band", _band(F.col("lat"), limit_km)).withColumn("__cell", _cell(F.col("lng"), F.col("__band"), limit_km))
    bands = F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: k + _band(F.col("c_lat"), limit_km))
    around = candidates.withColumn("__band", F.explode(bands))
    cells = F.array_distinct(F.array(*[_cell(F.col("c_lng"), F.col("__band"), limit_km, k) for k in (-1, 0, 1)]))
    paired = placed.join(around.withColumn("__cell", F.explode(cells)), [name, "__band", "__cell"])
    measured = paired.withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")))
    return measured.where(F.col("km") <= limit_km).groupBy(name, "lat", "lng").agg(
        F.min_by("candidate_id", F.struct("km", "candidate_id")).alias("candidate_id"), F.min("km").alias("km")
    )


KM_PER_DEGREE = 111.0  # a little less than a degree of latitude has


def _band(lat: Column, limit_km: float) -> Column:
    return F.floor(lat / (limit_km / KM_PER_DEGREE))


def _cell(lng: Column, band: Column, limit_km: float, step: int = 0) -> Column:
    """Cell of a longitude inside a band of latitudes, ``step`` cells further.
    All cells of a band have the same width: at least the limit at the edge of
    the next band towards the pole, with a fifth to spare."""
    edge = F.least((F.greatest(F.abs(band), F.abs(band + 1)) + 1) * (limit_km / KM_PER_DEGREE), F.lit(89.9))
    count = F.greatest(F.floor(360.0 / (1.2 * limit_km / KM_PER_DEGREE / F.cos(F.radians(edge)))), F.lit(1))
    return F.pmod(F.floor((lng + 180.0) / (360.0 / count)) + step, count)


def not_yet_fetched(places: DataFrame, cache: DataFrame, name: str = "name") -> DataFrame:
    """Names absent from the cache; a null result counts as present."""
    return places.join(cache.select(name).distinct(), name, "left_anti")
