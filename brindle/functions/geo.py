"""Points as structs of lon and lat: distance, polygons and their literals, all in column arithmetic."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GEOJSON = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))])

EARTH_KM = 6371.0087714
_NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def parse_point(text: str) -> tuple[float, float]:
    m = re.fullmatch(rf"\s*POINT\s*\(\s*({_NUMBER})\s+({_NUMBER})\s*\)\s*", text, re.I)
    if not m or abs(float(m[2])) > 90 or abs(float(m[1])) > 180:
        raise ValueError(f"not a point: {text}")
    return float(m[1]), float(m[2])


def parse_polygon(text: str) -> list[tuple[float, float]]:
    m = re.fullmatch(r"\s*POLYGON\s*\(\s*\(([^()]*)\)\s*\)\s*", text, re.I)
    ring = [tuple(map(float, p.split())) for p in m[1].split(",")] if m else []
    if len(ring) < 4 or any(len(p) != 2 for p in ring) or max(abs(a - b) for a, b in zip(ring[0], ring[-1])) > 1e-6:
        raise ValueError(f"not a closed ring of four points or more: {text}")
    return ring


def is_point(value: Column) -> Column:
    """Whether a GeoJSON value is a point on the globe; never null."""
    at = value.getField("coordinates")
    sound = (value.getField("type") == "Point") & F.size(at).between(2, 3) & (F.abs(F.get(at, 0)) <= 180) & (F.abs(F.get(at, 1)) <= 90)
    return F.coalesce(sound, F.lit(False))


def from_geojson(value: Column) -> Column:
    """The stored form of a GeoJSON point; null for what is none."""
    at = value.getField("coordinates")
    return F.when(is_point(value), F.struct(F.get(at, 0).alias("lon"), F.get(at, 1).alias("lat")))


def to_geojson(point: Column) -> Column:
    return F.when(point.isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(point.getField("lon"), point.getField("lat")).alias("coordinates")))


def distance_km(point: Column, lon: float, lat: float) -> Column:
    """Great-circle distance; null for a null point."""
    la, lo = F.radians(point.getField("lat")), F.radians(point.getField("lon"))
    here_la, here_lo = F.radians(F.lit(lat)), F.radians(F.lit(lon))
    h = F.pow(F.sin((la - here_la) / 2), 2) + F.cos(la) * F.cos(here_la) * F.pow(F.sin((lo - here_lo) / 2), 2)
    return F.when(h.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))))


def within_box(point: Column, lon: float, lat: float, km: float) -> Column:
    """A box that holds the circle, over the date line in two parts: ranges that a scan can push down."""
    reach = km / EARTH_KM * 57.29577951308232 + 1e-6
    y, x = point.getField("lat"), point.getField("lon")
    band = (y >= lat - reach) & (y <= lat + reach)
    if abs(lat) + reach >= 90:
        return band  # a pole lies within: any longitude
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat))))) + 1e-6
    west, east = lon - wide, lon + wide
    if west < -180:
        return band & ((x >= west + 360) | (x <= east))
    if east > 180:
        return band & ((x >= west) | (x <= east - 360))
    return band & (x >= west) & (x <= east)


def in_polygon(point: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd ray cast in the plane; a ring across the date line is unrolled, and the point follows it."""
    out = [ring[0]]
    for lon, lat in ring[1:]:
        while lon - out[-1][0] > 180:
            lon -= 360
        while lon - out[-1][0] < -180:
            lon += 360
        out.append((lon, lat))
    low, high = min(p[0] for p in out), max(p[0] for p in out)
    y = point.getField("lat")

    def cast(x: Column) -> Column:
        odd = F.lit(False)
        for (x1, y1), (x2, y2) in zip(out, out[1:]):
            if y1 != y2:
                crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1)))
                odd = odd != crosses
        return odd

    x = point.getField("lon")
    hit = cast(x)
    if low < -180:
        hit = hit | cast(x - 360)
    if high > 180:
        hit = hit | cast(x + 360)
    return F.coalesce(hit, F.lit(False))
