"""Great-circle geometry on a sphere as column expressions; degrees and kilometres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0088


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    # rounding can pass 1 at antipodes; least() would turn a null into 1
    return 2 * radius * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def destination(lat: Column, lon: Column, heading: Column, km: Column) -> tuple[Column, Column]:
    """The point at ``km`` along ``heading``; the longitude is not wrapped again."""
    d, h, p = km / RADIUS_KM, F.radians(heading), F.radians(lat)
    s = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(h)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)))), lon + F.degrees(F.atan2(F.sin(h) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * s))


def nearest_of(lat: Column, lon: Column, places: list[tuple[str, float, float]]) -> Column:
    """``struct(km, place, name)`` of the nearest of a few fixed places, without a join; the first wins a tie."""
    each = [F.struct(haversine(lat, lon, F.lit(y), F.lit(x)).alias("km"), F.lit(i).alias("place"), F.lit(name).alias("name")) for i, (name, y, x) in enumerate(places)]
    return F.least(*each) if len(each) > 1 else each[0]
