"""Points, distances and planar shapes without a spatial library.

Points are pairs of columns (longitude or x, latitude or y), shapes are WKT.
Predicates on shapes are Arrow-batched and evaluated in numpy.
"""

from __future__ import annotations

import json
import math
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6_371_008.8


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Metres between two geography points."""
    a, b = F.radians(_col(lat1)), F.radians(_col(lat2))
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(_col(lon2) - _col(lon1)) / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def planar(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(_col(x1) - _col(x2), 2) + F.pow(_col(y1) - _col(y2), 2))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out, by keys or evenly, to four tasks a core, for work that their bytes don't show: a small file is one task otherwise."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def dwithin_join(left: DataFrame, right: DataFrame, lon: str, lat: str, lon2: str, lat2: str, metres: float) -> DataFrame:
    """Pairs of points at most so far apart.

    Points meet in cells half the distance high and about as wide in metres, so
    that cells towards the poles hold no more of the surface than others.  The
    left side is in its own cells, the right side (take the smaller table) in all
    that a circle around it can touch; the join is on equal cells with a recheck.
    """
    reach = math.degrees(metres / RADIUS) * (1 + 1e-9) + 1e-9
    step = max(reach / 2, 1e-6)
    band = lambda y: F.floor(y / step)
    # So many cells round the earth, in all bands that a place may be in.
    columns = lambda b: F.greatest(F.floor(F.lit(360.0 / step) * F.cos(F.radians(F.least(F.abs((b + 0.5) * step), F.lit(90.0))))), F.lit(1))
    cell = lambda x, b: F.floor((x + 180) / (F.lit(360.0) / columns(b)))
    a = left.withColumn("__band", band(_col(lat))).withColumn("__cell", F.pmod(cell(_col(lon), F.col("__band")), columns(F.col("__band"))))
    # A place that isn't a number is near none.
    b = right.where(~F.isnan(_col(lat2)) & ~F.isnan(_col(lon2))).withColumn("__band", F.explode(F.sequence(band(_col(lat2) - reach), band(_col(lat2) + reach))))
    # A circle is widest so many degrees from its middle; one around a pole has all of them.
    wide = F.when(F.abs(_col(lat2)) + reach >= 90, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(F.lit(math.sin(math.radians(min(reach, 90.0)))) / F.cos(F.radians(_col(lat2))), F.lit(1.0)))) * (1 + 1e-9) + 1e-9)
    n, low, high = columns(F.col("__band")), cell(_col(lon2) - F.col("__wide"), F.col("__band")), cell(_col(lon2) + F.col("__wide"), F.col("__band"))
    cells = F.when(high - low + 1 >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.sequence(F.pmod(low, n), F.pmod(low, n) + high - low))
    b = b.withColumn("__wide", wide).withColumn("__cell", F.explode(cells)).withColumn("__cell", F.pmod("__cell", n)).drop("__wide")
    # Many pairs come of few bytes, so cells are dealt out before they meet.
    met = spread(a, "__band", "__cell").join(b, ["__band", "__cell"]).withColumn("distance", haversine(lon, lat, lon2, lat2))
    return met.where(F.col("distance") <= metres).drop("__band", "__cell")


def knn(points: DataFrame, lon: str, lat: str, at: tuple[float, float], k: int, tie: str) -> DataFrame:
    """The k nearest points to a place: a top-k, which no full sort precedes."""
    return points.withColumn("distance", haversine(lon, lat, at[0], at[1])).orderBy("distance", tie).limit(k)


_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def parse_wkt(text: str) -> tuple[str, list]:
    """(type, coordinates) nested as in GeoJSON."""
    kind, body = re.fullmatch(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(?:ZM|Z|M)?\s*(\(.*\)|EMPTY)\s*", text, re.S).groups()
    names = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    if body == "EMPTY":
        return names[kind.upper()], []
    nested = re.sub(rf"({_NUMBER}(?:\s+{_NUMBER})*)", lambda m: "[" + ",".join(m[1].split()) + "]", body).replace("(", "[").replace(")", "]")
    found = json.loads(nested)
    return names[kind.upper()], found[0] if kind.upper() == "POINT" else found


def to_wkt(kind: str, coordinates: list) -> str:
    def show(c) -> str:
        return " ".join(f"{v:g}" for v in c) if not isinstance(c[0], list) else "(" + ", ".join(map(show, c)) + ")"

    body = f"({show(coordinates)})" if kind == "Point" else show(coordinates)
    return f"{kind.upper()}{body}"


def point_wkb(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def to_geojson(text: str) -> str:
    kind, coordinates = parse_wkt(text)
    return json.dumps({"type": kind, "coordinates": coordinates}, separators=(",", ":"))


def even_odd(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether a ray to the right leaves each point over an odd number of edges: of the boundary, left and lower sides count."""
    inside = np.zeros(len(x), bool)
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0)):
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


def _polygon(text: str) -> list[np.ndarray]:
    return [np.array(r, float)[:, :2] for r in parse_wkt(text)[1]]


def _odd(ring: np.ndarray, x: Column, y: Column) -> Column:
    """even_odd as an expression: the ring's edges are a literal array."""
    edges = [(*p, *q) for p, q in zip(ring.tolist(), np.roll(ring, -1, axis=0).tolist()) if p[1] != q[1]]
    crossed = lambda e: ((e[1] > y) != (e[3] > y)) & (x < (e[2] - e[0]) * (y - e[1]) / (e[3] - e[1]) + e[0])
    return F.size(F.filter(F.array(*[F.array(*map(F.lit, e)) for e in edges]), crossed)) % 2 == 1


def contains(wkt: str, x, y) -> Column:
    """Whether a fixed polygon holds each point; its box is looked at first.  No Python at run time."""
    rings = _polygon(wkt)
    (x0, y0), (x1, y1) = rings[0].min(axis=0), rings[0].max(axis=0)
    x, y = _col(x).cast("double"), _col(y).cast("double")
    found = _odd(rings[0], x, y)
    for hole in rings[1:]:
        found = found & ~_odd(hole, x, y)
    box = x.between(float(x0), float(x1)) & y.between(float(y0), float(y1))
    return F.when(box, found).otherwise(F.when(box.isNotNull(), F.lit(False)))


def _areas(wkt: pd.Series) -> pd.Series:
    """Planar area of polygons: shell without holes."""

    def one(text):
        if text is None:
            return None
        areas = [abs(np.dot(r[:, 0], np.roll(r[:, 1], -1)) - np.dot(r[:, 1], np.roll(r[:, 0], -1))) / 2 for r in _polygon(text)]
        return areas[0] - sum(areas[1:])

    return wkt.map(one)


def _lengths(wkt: pd.Series) -> pd.Series:
    """Planar length of line strings."""
    return wkt.map(lambda t: None if t is None else float(np.hypot(*np.diff(np.array(parse_wkt(t)[1], float)[:, :2], axis=0).T).sum()))


def st_area(wkt) -> Column:
    """Planar area of each polygon: the shell without its holes."""
    return F.pandas_udf(_areas, "double")(_col(wkt))


def st_length(wkt) -> Column:
    """Planar length of each line."""
    return F.pandas_udf(_lengths, "double")(_col(wkt))
