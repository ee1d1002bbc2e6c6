"""Geocoding, distance, border and point queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.functions.geo import haversine_km, vertex_centroid
from newsloom.operators import places as P
from newsloom.queries.base import EV, events, query, table

# Places: the words and the full names of the parts, with made coordinates.
_GAZ = (
    "(SELECT name, CAST(length(name) * 1.5 AS DOUBLE) AS lat, CAST(ascii(name) AS DOUBLE) AS lng, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS priority FROM "
    "(SELECT DISTINCT unnest(string_split(p_name, ' ') || [substr(p_name, 1, length(p_name) - 2)]) AS name FROM part))"
)


def gazetteer(spark, folder):
    words = F.concat(F.split("p_name", " "), F.array(F.expr("substring(p_name, 1, length(p_name) - 2)")))
    names = table(spark, folder, "part").select(F.explode(words).alias("name")).distinct()
    return names.select(
        "name", (F.length("name") * 1.5).alias("lat"), F.ascii("name").cast("double").alias("lng"),
        F.row_number().over(Window.orderBy("name")).alias("priority"),
    )


def _best(order: str) -> str:
    return (
        f"SELECT p_partkey, place, lat, lng FROM (SELECT p_partkey, g.name AS place, g.lat, g.lng, row_number() OVER (PARTITION BY p_partkey ORDER BY {order}) AS r "
        f"FROM part JOIN {_GAZ} g ON contains(p_name, g.name)) WHERE r = 1"
    )


@query(_best("length(g.name) DESC, g.priority"))
def geocode_longest(spark, folder):
    """A small gazetteer, compiled into the scan."""
    found = P.geocode(table(spark, folder, "part"), "p_name", gazetteer(spark, folder), "longest")
    return found.select("p_partkey", "place", "lat", "lng")


@query(_best("g.priority"))
def geocode_first(spark, folder):
    """The join form used for large gazetteers."""
    found = P.geocode(
        table(spark, folder, "part"), "p_name", gazetteer(spark, folder), "first", compile_limit=0
    )
    return found.select("p_partkey", "place", "lat", "lng")


@query(_best("length(g.name) DESC, g.priority"))
def geocode_longest_joined(spark, folder):
    found = P.geocode(
        table(spark, folder, "part"), "p_name", gazetteer(spark, folder), "longest", compile_limit=0
    )
    return found.select("p_partkey", "place", "lat", "lng")


@query(
    f"SELECT place, count(*) AS n, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS types FROM ({_best('length(g.name) DESC, g.priority')}) JOIN part USING (p_partkey) GROUP BY place"
)
def place_type_sets(spark, folder):
    found = P.geocode(table(spark, folder, "part"), "p_name", gazetteer(spark, folder), "longest")
    return P.place_type_sets(found, "p_type").select("place", "n", F.array_join("types", ",").alias("types"))


def _alerts(spark, folder):
    """Alerts whose place is the user's; a third of them fall on one place."""
    user = F.when(F.col("user_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id") % 40)
    rows = events(spark, folder).where("category = 'error'")
    return rows.select("id", "date", "time", F.concat(F.lit("alert in town "), F.lpad(user.cast("string"), 3, "0")).alias("location"))


_ALERTS = (
    f"(SELECT id, date, time, 'town ' || lpad(CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 40 END AS VARCHAR), 3, '0') AS place FROM {EV} WHERE category = 'error')"
)


def _towns(spark, folder):
    return _alerts(spark, folder).select(F.regexp_extract("location", r"town \d+", 0).alias("name")).distinct().select(
        "name", F.lit(33.0).alias("lat"), F.lit(35.0).alias("lng"), F.pmod(F.xxhash64("name"), F.lit(1_000_000)).cast("int").alias("priority")
    )


@query(
    f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY date, place ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY date, place) AS count FROM {_ALERTS}) "
    "SELECT date, place AS loc, CAST(pos // 20 AS INTEGER) AS part, max(count) AS count, string_agg(time, ',' ORDER BY id) AS times FROM p GROUP BY date, place, pos // 20"
)
def alert_points(spark, folder):
    found = P.geocode(_alerts(spark, folder), "location", _towns(spark, folder), "longest")
    points = P.alert_points(found, order="id", part_size=20, width=64)
    return points.select("date", "loc", "part", "count", F.array_join("times", ",").alias("times"))


@query(
    "WITH s AS (SELECT s_nationkey AS k, s_suppkey AS c, 30 + (s_suppkey % 50) / 100.0 AS la, 35 + (s_suppkey % 70) / 100.0 AS ln FROM supplier), "
    "p AS (SELECT n_nationkey AS k, n_name AS name, 30.2 AS lat, 35.3 AS lng FROM nation), "
    "d AS (SELECT p.name, s.c, 2 * 6371.0 * asin(sqrt(pow(sin(radians(s.la - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.la)) * pow(sin(radians(s.ln - p.lng) / 2), 2))) AS km FROM p JOIN s USING (k)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY km, c) AS r FROM d WHERE km <= 20) "
    "SELECT name, c AS candidate_id, round(km, 4) AS km FROM r WHERE r = 1"
)
def nearest_within(spark, folder):
    nation = table(spark, folder, "nation")
    places = nation.select(F.col("n_name").alias("name"), F.lit(30.2).alias("lat"), F.lit(35.3).alias("lng"))
    supplier = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    candidates = supplier.select(
        F.col("n_name").alias("name"), F.col("s_suppkey").alias("candidate_id"),
        (30 + (F.col("s_suppkey") % 50) / 100.0).alias("c_lat"), (35 + (F.col("s_suppkey") % 70) / 100.0).alias("c_lng"),
    )
    return P.nearest_within(places, candidates).select("name", "candidate_id", F.round("km", 4).alias("km"))


@query("SELECT c_custkey, round(2 * 6371.0 * asin(sqrt(pow(sin(radians((c_custkey % 30) - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(CAST(c_custkey % 30 AS DOUBLE))) * pow(sin(radians((c_nationkey * 2.0) - 20.0) / 2), 2))), 3) AS km FROM customer")
def distances(spark, folder):
    km = haversine_km(F.lit(10.0), F.lit(20.0), (F.col("c_custkey") % 30).cast("double"), F.col("c_nationkey") * 2.0)
    return table(spark, folder, "customer").select("c_custkey", F.round(km, 3).alias("km"))


@query("SELECT s_suppkey, round((s_suppkey + (s_suppkey + 4) + (s_suppkey + 2) + 1) / 4.0, 6) AS lat, round((s_nationkey * 3 + 9) / 4.0, 6) AS lng FROM supplier")
def vertex_centroids(spark, folder):
    x, y = F.col("s_nationkey").cast("double"), F.col("s_suppkey").cast("double")
    outer = F.array(F.array(x, y), F.array(x, y + 4), F.array(x, y + 2))
    hole = F.array(F.array(F.lit(9.0), F.lit(1.0)))
    rows = table(spark, folder, "supplier").select("s_suppkey", vertex_centroid(F.array(outer, hole)).alias("c"))
    return rows.select("s_suppkey", F.round("c.lat", 6).alias("lat"), F.round("c.lng", 6).alias("lng"))


@query("SELECT n_name AS name, CASE WHEN n_regionkey = 1 THEN 'polygon' ELSE 'marker' END AS shape FROM nation")
def border_lookup(spark, folder):
    nation = table(spark, folder, "nation").withColumnRenamed("n_name", "name")
    borders = nation.where("n_regionkey = 1").select("name", F.lit("{}").alias("geojson"))
    return P.border_lookup(nation.select("name"), borders).select("name", "shape")


@query("SELECT n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def not_yet_fetched(spark, folder):
    nation = table(spark, folder, "nation")
    cache = table(spark, folder, "supplier").where("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return P.not_yet_fetched(nation.select(F.col("n_name").alias("name")), cache.select(F.col("n_name").alias("name"), F.lit(None).alias("geojson")))


def _coords(spark, folder):
    rows = events(spark, folder)
    return rows.select(
        "date", F.col("id").alias("position"), F.col("title").alias("loc"), F.col("value").alias("lat"), (F.col("value") * 2).alias("lng")
    )


@query(f"SELECT title AS loc, arg_max(value, id) AS lat, arg_max(value * 2, id) AS lng FROM {EV} GROUP BY title")
def last_wins_coords(spark, folder):
    return P.coords_by_day(_coords(spark, folder), "last")


@query(f"SELECT title AS loc, arg_min(value, id) AS lat, arg_min(value * 2, id) AS lng FROM {EV} GROUP BY title")
def first_wins_coords(spark, folder):
    return P.coords_by_day(_coords(spark, folder), "first")


@query(
    "WITH a AS (SELECT p_name AS name, p_size * 1.0 AS lat, p_partkey AS k, 0 AS part FROM part WHERE p_size < 20), b AS (SELECT p_name, p_retailprice, p_partkey, 1 FROM part WHERE p_size >= 20), "
    "u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT name, CAST(lat AS DOUBLE) AS lat FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY part, k) AS r FROM u) WHERE r = 1"
)
def load_gazetteer(spark, folder):
    part = table(spark, folder, "part")

    def source(condition, lat):
        return part.where(condition).select(
            F.col("p_name").alias("name"), lat.cast("double").alias("lat"), F.lit(0.0).alias("lng"), F.col("p_partkey").cast("int").alias("priority")
        )

    return P.load_gazetteer(source("p_size < 20", F.col("p_size")), source("p_size >= 20", F.col("p_retailprice"))).select("name", "lat")
