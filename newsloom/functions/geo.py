"""Distances, centroids and display buckets of places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0  # fixed value


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance."""
    half = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    )
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def vertex_centroid(rings: Column) -> Column:
    """Mean of all ``[lng, lat]`` vertices of a list of rings.

    A polygon passes its rings, a multi-polygon ``flatten(polygons)``.
    """
    points = F.flatten(rings)
    total = F.aggregate(
        points,
        F.struct(F.lit(0.0).alias("lng"), F.lit(0.0).alias("lat")),
        lambda acc, p: F.struct((acc["lng"] + p[0]).alias("lng"), (acc["lat"] + p[1]).alias("lat")),
    )
    count = F.size(points)
    return F.when(count > 0, F.struct((total["lat"] / count).alias("lat"), (total["lng"] / count).alias("lng")))


def intensity_bucket(count: Column) -> Column:
    """Four levels (fixed bounds 2, 4, 7)."""
    return F.when(count >= 7, 3).when(count >= 4, 2).when(count >= 2, 1).otherwise(0)


def intensity_opacity(count: Column) -> Column:
    """D39 (fixed formula of the map)."""
    return F.lit(0.35) + F.least(count, F.lit(10)) * 0.04


def round_exact(value: Column, digits: int = 1, ties: str = "even") -> Column:
    """Rounding of the exact binary value of a double (``bround`` rounds its
    shortest decimal text: 0.15 is less than 15/100). ``ties``: ``even``, or
    ``up`` for the rule of the pages.

    The product with the power of ten is split into the rounded product and its
    exact error, so the comparison with the half is exact."""
    scale = float(10**digits)

    def rounded(x: Column) -> Column:
        split = 134217729.0 * x
        high = split - (split - x)
        product = x * scale
        error = (high * scale - product) + (x - high) * scale
        below = F.floor(product).cast("double")
        over = (product - below - 0.5) + error
        tie = F.lit(True) if ties == "up" else below % 2 != 0
        return (below + F.when((over > 0) | ((over == 0) & tie), 1.0).otherwise(0.0)) / scale

    return F.get(F.transform(F.array(value.cast("double")), rounded), F.lit(0))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent as the pages show it, 0 for an empty whole."""
    return F.when(whole > 0, round_exact(part / whole * 100.0, digits, "up")).otherwise(F.lit(0.0))
