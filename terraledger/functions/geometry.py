"""GeoJSON geometry as nested arrays, measured with Catalyst's higher-order functions.

A parsed geometry is STRUCT<type, parts ARRAY<STRUCT<type, coords>>>, where coords is always
polygons -> rings -> positions -> ordinates: a point is [[[p]]], a line [[line]], the points of a
multipoint one ring, the lines of a multiline the rings of one polygon. Members of collections are
flattened into parts. Measures use the first two ordinates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")
_COLLECTION = "GeometryCollection"
_SHAPE = "type string, coordinates string, geometries array<string>"


def _coords(kind: Column, text: Column) -> Column:
    def read(depth: int) -> Column:
        return F.from_json(text, "array<" * depth + "double" + ">" * depth)

    return (
        F.when(kind == "Point", F.array(F.array(F.array(read(1)))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(F.array(read(2))))
        .when(kind.isin("Polygon", "MultiLineString"), F.array(read(3)))
        .when(kind == "MultiPolygon", read(4))
    )


def _opened(members: Column) -> Column:
    """Members with each collection among them replaced by its own members."""
    shapes = F.transform(members, lambda g: F.struct(g.alias("g"), F.from_json(g, _SHAPE).alias("s")))
    own = F.transform(shapes, lambda x: F.when(x["s"]["type"] == _COLLECTION, F.coalesce(x["s"]["geometries"], F.array().cast("array<string>"))).otherwise(F.array(x["g"])))
    return F.flatten(own)


def leaves(geojson: Column) -> Column:
    """The texts of a geometry's simple members, however deep collections lie in each other: one for any other geometry."""
    # As many rounds as the text names collections: no more can lie in each other.
    rounds = F.size(F.split(geojson, _COLLECTION)) - 1
    return F.when(rounds > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), F.array(geojson), lambda members, _: _opened(members))).otherwise(F.array(geojson))


def parse(geojson: Column) -> Column:
    shapes = F.transform(leaves(geojson), lambda g: F.from_json(g, "type string, coordinates string"))
    parts = F.transform(shapes, lambda s: F.struct(s["type"].alias("type"), _coords(s["type"], s["coordinates"]).alias("coords")))
    kind = F.get_json_object(geojson, "$.type")
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), parts.alias("parts")))


def positions(geom: Column) -> Column:
    return F.flatten(F.flatten(F.flatten(F.transform(geom["parts"], lambda p: p["coords"]))))


def bbox(geom: Column) -> Column:
    """STRUCT x0, y0, x1, y1; null where there is no position."""
    none = F.struct(*[F.lit(v).alias(c) for c, v in (("x0", math.inf), ("y0", math.inf), ("x1", -math.inf), ("y1", -math.inf))])

    def wider(b: Column, p: Column) -> Column:
        return F.struct(F.least(b["x0"], p[0]).alias("x0"), F.least(b["y0"], p[1]).alias("y0"), F.greatest(b["x1"], p[0]).alias("x1"), F.greatest(b["y1"], p[1]).alias("y1"))

    # One pass over the positions; finished within, so that the box is one expression.
    return F.aggregate(positions(geom), none, wider, lambda b: F.when(b["x0"] <= b["x1"], b))


def center(box: Column) -> Column:
    """The middle of a bounding box, which stands for the centroid everywhere here."""
    return F.struct(((box["x0"] + box["x1"]) / 2).alias("x"), ((box["y0"] + box["y1"]) / 2).alias("y"))


def _steps(ring: Column, f) -> Column:
    """f of each position and the next one."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), f)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _planar_ring(ring: Column) -> Column:
    return F.abs(_sum(_steps(ring, lambda p, q: p[0] * q[1] - q[0] * p[1])) / 2)


def _spherical_ring(ring: Column) -> Column:
    def step(p: Column, q: Column) -> Column:
        d = F.radians(q[0] - p[0])
        d = F.when(d > F.pi(), d - 2 * F.pi()).when(d < -F.pi(), d + 2 * F.pi()).otherwise(d)
        return d * (2 + F.sin(F.radians(p[1])) + F.sin(F.radians(q[1])))

    return F.when(F.size(ring) < 4, F.lit(0.0)).otherwise(F.abs(_sum(_steps(ring, step)) * (EARTH_RADIUS_M**2 / 2)))


def _areal(geom: Column, ring_area) -> Column:
    def polygon(rings: Column) -> Column:
        holes = _sum(F.transform(F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1))), ring_area))
        return F.when(F.size(rings) > 0, F.greatest(F.lit(0.0), ring_area(F.get(rings, 0)) - holes)).otherwise(F.lit(0.0))

    areal = F.filter(geom["parts"], lambda p: p["type"].isin("Polygon", "MultiPolygon"))
    return _sum(F.transform(F.flatten(F.transform(areal, lambda p: p["coords"])), polygon))


def area(geom: Column) -> Column:
    """Planar, in squared degrees; 0 for what has no area."""
    return _areal(geom, _planar_ring)


def geodesic_area_m2(geom: Column) -> Column:
    return _areal(geom, _spherical_ring)


def distance_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return EARTH_RADIUS_M * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def expanded(box: Column, metres: Column) -> Column:
    """The box grown by metres on every side; null where its middle lies beyond a pole, as nothing is so many metres from there."""
    dy, across = metres / 111320, F.cos(F.radians((box["y0"] + box["y1"]) / 2))
    dx = metres / F.greatest(F.lit(1.0), 111320 * across)
    return F.when(across >= 0, F.struct((box["x0"] - dx).alias("x0"), (box["y0"] - dy).alias("y0"), (box["x1"] + dx).alias("x1"), (box["y1"] + dy).alias("y1")))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"]) & (a["y0"] <= b["y1"]) & (a["y1"] >= b["y0"])


def in_bounds(geom: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Inclusive overlap with west, south, east, north; a missing geometry passes."""
    return geom.isNull() | box_in(bbox(geom), bounds)


def box_in(b: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Inclusive overlap of a box with west, south, east, north; false without a box."""
    w, s, e, n = map(float, bounds)
    # By a list of one, so that the box is worked out once.
    return F.exists(F.array(b), lambda x: F.coalesce((x["x0"] <= e) & (x["x1"] >= w) & (x["y0"] <= n) & (x["y1"] >= s), F.lit(False)))


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; an edge counts if its ends lie on either side of y, one of them strictly above."""
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))
    crossed = F.zip_with(ring, before, lambda p, q: ((p[1] > y) != (q[1] > y)) & (x < (q[0] - p[0]) * (y - p[1]) / F.nullif(q[1] - p[1], F.lit(0.0)) + p[0]))
    return F.size(F.filter(crossed, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def polygon_contains(geom: Column, x: Column, y: Column) -> Column:
    """Whether a Polygon (no other type) has the point in its shell and in no hole."""
    rings = F.get(F.get(geom["parts"], 0)["coords"], 0)
    holes = F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1)))
    inside = ring_contains(F.get(rings, 0), x, y) & ~F.exists(holes, lambda r: ring_contains(r, x, y))
    return (geom["type"] == "Polygon") & F.coalesce(inside, F.lit(False))


def endpoints(geom: Column) -> Column:
    """STRUCT x0, y0, x1, y1 of a line's two ends (of the first and last line of several); null for other types."""
    lines = F.filter(F.flatten(F.get(geom["parts"], 0)["coords"]), lambda r: F.size(r) > 0)
    a, b = F.get(F.get(lines, 0), 0), F.element_at(F.element_at(lines, -1), -1)
    ends = F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1"))
    return F.when(geom["type"].isin("LineString", "MultiLineString") & (F.size(lines) > 0), ends)


def is_areal(kind: Column) -> Column:
    return kind.isin("Polygon", "MultiPolygon")


def point_json(x: Column, y: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")))


def rectangle_json(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    ring = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
