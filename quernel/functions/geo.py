"""Cells, distances and polygons as column expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLANAR_RADIUS_KM, PLANAR_PI, SPHERE_RADIUS_M = 6378.137, 3.1415, 6378137.0
CELL_BITS = 15
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def cell_lat(lat: Column) -> Column:
    return F.least(F.floor((lat + 90.0) / 180.0 * (1 << CELL_BITS)), F.lit((1 << CELL_BITS) - 1)).cast("int")


def cell_lng(lng: Column) -> Column:
    return F.least(F.floor((lng + 180.0) / 360.0 * (1 << CELL_BITS)), F.lit((1 << CELL_BITS) - 1)).cast("int")


def cell_of(lat: float, lng: float) -> tuple[int, int]:
    top = (1 << CELL_BITS) - 1
    return min(int((lat + 90.0) / 180.0 * (1 << CELL_BITS) // 1), top), min(int((lng + 180.0) / 360.0 * (1 << CELL_BITS) // 1), top)


def geohash(lat: Column, lng: Column) -> Column:
    """Six characters: the bits of both cells in turn, longitude first."""
    y, x, out = cell_lat(lat), cell_lng(lng), []
    for k in range(6):
        value = F.lit(0)
        for j in range(5):
            bit = 5 * k + j
            axis = x if bit % 2 == 0 else y
            value = value * 2 + F.shiftright(axis, CELL_BITS - 1 - bit // 2).bitwiseAND(F.lit(1))
        out.append(F.substring(F.lit(_BASE32), value + 1, F.lit(1)))
    return F.concat(*out)


def planar_km(lat: Column, lng: Column, lat0: float, lng0: float) -> Column:
    """Planar distance around the middle latitude, to three decimals."""
    rad = PLANAR_PI / 180.0
    dx = (lng - lng0) * rad * PLANAR_RADIUS_KM * F.cos((lat + lat0) / 2.0 * rad)
    dy = (lat - lat0) * rad * PLANAR_RADIUS_KM
    return F.round(F.sqrt(dx * dx + dy * dy), 3)


def within_box(lat: Column, lng: Column, lat0: float, lng0: float, km: float) -> Column:
    """A box that holds the circle: plain comparisons, so that scans can skip by statistics.

    Planar distances do not wrap at 180 degrees, so the box does not either;
    near the poles it is as wide as all longitudes.
    """
    degree = PLANAR_PI / 180.0 * PLANAR_RADIUS_KM
    d = km / degree * 1.001 + 1e-6
    box = (lat >= lat0 - d) & (lat <= lat0 + d)
    narrow = min(math.cos((lat0 + x / 2) * PLANAR_PI / 180.0) for x in (-d, 0, d))  # the middle latitude is half way
    if narrow < 0.01:
        return box
    e = d / narrow * 1.001
    return box & (lng >= lng0 - e) & (lng <= lng0 + e)


def haversine_m(lat: Column, lng: Column, lat0: float, lng0: float) -> Column:
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(lat0))) * F.pow(F.sin(F.radians(lng - lng0) / 2), 2)
    return 2 * SPHERE_RADIUS_M * F.asin(F.sqrt(a))


def neighbours(lat_cell: Column, lng_cell: Column) -> Column:
    """The nine cells around and including one, without those past a pole; longitudes go round."""
    n = 1 << CELL_BITS
    cells = F.array(*[F.struct((lat_cell + i).alias("lat_cell"), F.pmod(lng_cell + j, F.lit(n)).cast("int").alias("lng_cell")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return F.filter(cells, lambda x: x["lat_cell"].between(0, n - 1))


def destination(lat: Column, lng: Column, bearing: Column, metres: Column) -> Column:
    """Where one arrives on a sphere from a place by a bearing: struct of lat and lng."""
    d, b, p, q = metres / SPHERE_RADIUS_M, F.radians(bearing), F.radians(lat), F.radians(lng)
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    turn = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))
    return F.struct(F.degrees(to).alias("lat"), F.degrees(q + turn).alias("lng"))


Point = tuple[float, float]


def parse_point(value) -> Point:
    """(lat, lng) of "lat,lng", [lat, lng] or {"latitude": .., "longitude": ..}."""
    if isinstance(value, str):
        value = value.split(",")
    elif isinstance(value, dict):
        value = [value["latitude"], value["longitude"]]
    lat, lng = (float(x) for x in value)
    if not (-90 <= lat <= 90 and -180 <= lng <= 180):
        raise ValueError(f"no place: {lat}, {lng}")
    return lat, lng


def parse_polygon(value) -> list[Point]:
    """(lng, lat) vertices of WKT `POLYGON((lng lat, ...))` or of a list of points, closed."""
    if isinstance(value, str):
        m = re.fullmatch(r"\s*POLYGON\s*\(\(([^()]*)\)\)\s*", value, re.I)
        if not m:
            raise ValueError("not a POLYGON")
        out = [tuple(map(float, p.split())) for p in m[1].split(",")]
    else:
        out = [(lng, lat) for lat, lng in map(parse_point, value)]
    if len(out) < 3 or any(len(p) != 2 for p in out):
        raise ValueError("a polygon has three vertices at least")
    return out if out[0] == out[-1] else [*out, out[0]]


def box_cells(polygon: Sequence[Point]) -> tuple[int, int, int, int]:
    """Least and greatest cells of the bounding box: lat, lat, lng, lng."""
    (a, c), (b, d) = cell_of(min(p[1] for p in polygon), min(p[0] for p in polygon)), cell_of(max(p[1] for p in polygon), max(p[0] for p in polygon))
    return a, b, c, d


def in_polygon_cells(lat: Column, lng: Column, polygon: Sequence[Point]) -> Column:
    a, b, c, d = box_cells(polygon)
    return cell_lat(lat).between(a, b) & cell_lng(lng).between(c, d)


def in_polygon(lat: Column, lng: Column, polygon: Sequence[Point]) -> Column:
    """Even-odd rule, edge by edge."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:], strict=False):
        if y1 != y2:
            spans = (F.lit(y1) > lat) != (F.lit(y2) > lat)
            crossings = crossings + F.when(spans & (lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def to_polygon(lat: Column, lng: Column, polygon: Sequence[Point]) -> Column:
    """Planar distance in degrees to the nearest edge."""
    out = []
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:], strict=False):
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lng - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / n)) if n else F.lit(0.0)
        out.append(F.sqrt(F.pow(lng - (x1 + t * (x2 - x1)), 2) + F.pow(lat - (y1 + t * (y2 - y1)), 2)))
    return F.least(*out)


def shape_column(wkt: Column) -> Column:
    """`POLYGON((lng lat, ..))` as closed array<struct<lng, lat>>; null for what is none."""
    inside = F.regexp_extract(wkt, r"(?i)^\s*POLYGON\s*\(\(([^()]*)\)\)\s*$", 1)
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  what `then` uses several times is made once

    def of(points: Column) -> Column:
        made = F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("lng"), F.get(p, F.lit(1)).try_cast("double").alias("lat")))
        return once(made, lambda m: F.when(whole(points, m), F.when(F.get(m, F.lit(0)) == F.element_at(m, -1), m).otherwise(F.concat(m, F.slice(m, 1, 1)))))

    def whole(points: Column, made: Column) -> Column:
        return (F.size(made) >= 3) & F.forall(points, lambda p: F.size(p) == 2) & F.forall(made, lambda p: p["lng"].isNotNull() & p["lat"].isNotNull())

    return once(F.transform(F.split(inside, r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+")), of)


#: Shapes with up to so many edges are tested by compiled code, an expression for each edge.
UNROLLED = 8


def in_shape(lat: Column, lng: Column, shape: Column) -> Column:
    """Even-odd rule over a column of closed vertices; a loop over the edges, which Spark interprets, only where there are more than UNROLLED."""
    edges = F.transform(F.sequence(F.lit(1), F.size(shape) - 1), lambda i: F.struct(F.get(shape, i - 1).alias("a"), F.get(shape, i).alias("b")))

    def crosses(e) -> Column:
        x1, y1, x2, y2 = e["a"]["lng"], e["a"]["lat"], e["b"]["lng"], e["b"]["lat"]
        return ((y1 > lat) != (y2 > lat)) & (lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)

    few = F.lit(0)
    for i in range(UNROLLED):
        few = few + F.when(crosses({"a": F.get(shape, F.lit(i)), "b": F.get(shape, F.lit(i + 1))}), 1).otherwise(0)  # an edge that is not there crosses nothing
    return F.when(F.size(shape) <= UNROLLED + 1, few % 2 == 1).otherwise(F.size(F.filter(edges, crosses)) % 2 == 1)


def places_in_shapes(places: DataFrame, shapes: DataFrame, lat: str, lng: str, shape: str, exact: bool = True, bits: int = 5) -> DataFrame:
    """Joins a table of places with a table of shapes: each place with each shape that holds it.

    Both meet in coarse cells of `bits` bits of latitude and longitude, so it
    is an equality join that deals out and splits like any other; a shape has a
    row for each coarse cell of its box. Files say nothing of how many rows
    shapes become, so these are dealt out by cell with the places and not sent
    to where the places lie, which may be one task. Within a cell the box in fine cells
    decides, then the outline if `exact`.
    """
    shift = 1 << (CELL_BITS - bits)
    coarse = lambda c: F.floor(c / shift).cast("int")
    low, high = (lambda n: F.array_min(F.transform(shape, lambda p: p[n]))), (lambda n: F.array_max(F.transform(shape, lambda p: p[n])))
    box = shapes.withColumns({"__a": cell_lat(low("lat")), "__b": cell_lat(high("lat")), "__c": cell_lng(low("lng")), "__d": cell_lng(high("lng"))}).where(F.col(shape).isNotNull())
    box = box.withColumn("__y", F.explode(F.sequence(coarse(F.col("__a")), coarse(F.col("__b"))))).withColumn("__x", F.explode(F.sequence(coarse(F.col("__c")), coarse(F.col("__d")))))
    at = places.withColumns({"__lat": cell_lat(F.col(lat)), "__lng": cell_lng(F.col(lng))})
    at = at.withColumns({"__py": coarse(F.col("__lat")), "__px": coarse(F.col("__lng"))})
    inside = (F.col("__py") == F.col("__y")) & (F.col("__px") == F.col("__x")) & F.col("__lat").between(F.col("__a"), F.col("__b")) & F.col("__lng").between(F.col("__c"), F.col("__d"))
    found = at.join(box.hint("merge"), inside)
    found = found.where(in_shape(F.col(lat), F.col(lng), F.col(shape))) if exact else found
    return found.drop("__a", "__b", "__c", "__d", "__y", "__x", "__lat", "__lng", "__py", "__px")
