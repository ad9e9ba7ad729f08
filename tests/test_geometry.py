import json
import math

import pytest
from pyspark.sql import functions as F

from terraledger.functions import crs, geometry, overlap, text

SQUARE = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}
HOLED = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]}
MULTI = {"type": "MultiPolygon", "coordinates": [SQUARE["coordinates"], [[[5, 5], [6, 5], [6, 6], [5, 6], [5, 5]]]]}
LINE = {"type": "LineString", "coordinates": [[0, 0], [1, 3], [2, 1]]}
NESTED = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [9, 9, 5]}, {"type": "GeometryCollection", "geometries": [SQUARE, LINE]}]}


def measure(spark, shapes, *cols):
    df = spark.createDataFrame([(i, None if s is None else json.dumps(s)) for i, s in enumerate(shapes)], "i int, j string").withColumn("g", geometry.parse(F.col("j")))
    return [tuple(r) for r in df.orderBy("i").select(*[c(F.col("g")) for c in cols]).collect()]


def test_measures(spark):
    got = measure(spark, [SQUARE, HOLED, MULTI, LINE, NESTED, None, {"type": "Point", "coordinates": [1.5, -2]}], geometry.area, lambda g: F.to_json(geometry.bbox(g)))
    assert [g[0] for g in got] == [4, 15, 5, 0, 4, None, 0]
    assert json.loads(got[4][1]) == {"x0": 0, "y0": 0, "x1": 9, "y1": 9} and json.loads(got[6][1]) == {"x0": 1.5, "y0": -2, "x1": 1.5, "y1": -2}
    assert got[5][1] is None


def test_geodesic_area_and_distance(spark):
    r = geometry.EARTH_RADIUS_M
    want = math.radians(2) * (math.sin(math.radians(2)) - math.sin(0)) * r * r
    assert measure(spark, [SQUARE], geometry.geodesic_area_m2)[0][0] == pytest.approx(want, rel=1e-6)
    d = spark.range(1).select(geometry.distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))).first()[0]
    assert d == pytest.approx(math.pi / 2 * r)


def test_containment_and_ends(spark):
    inside = lambda x, y: lambda g: geometry.polygon_contains(g, F.lit(x), F.lit(y))
    got = measure(spark, [HOLED, MULTI, LINE], inside(0.5, 0.5), inside(1.5, 1.5), inside(9.0, 9.0))
    assert got == [(True, False, False), (False, False, False), (False, False, False)]
    ends = measure(spark, [LINE, SQUARE, {"type": "MultiLineString", "coordinates": [[[0, 1], [2, 3]], [[4, 5], [6, 7]]]}], lambda g: F.to_json(geometry.endpoints(g)))
    assert json.loads(ends[0][0]) == {"x0": 0, "y0": 0, "x1": 2, "y1": 1} and ends[1][0] is None and json.loads(ends[2][0]) == {"x0": 0, "y0": 1, "x1": 6, "y1": 7}


def test_bounds(spark):
    f = lambda g: geometry.in_bounds(g, (2, 2, 3, 3))
    assert [x[0] for x in measure(spark, [SQUARE, {"type": "Point", "coordinates": [3.1, 3]}, None], f)] == [True, False, True]


def test_overlap_closed_forms():
    box = lambda x0, y0, x1, y1: {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}
    assert overlap.iou(box(0, 0, 2, 2), box(0, 0, 2, 2)) == 1
    assert overlap.iou(box(0, 0, 2, 2), box(1, 0, 3, 2)) == pytest.approx(1 / 3)
    assert overlap.iou(box(0, 0, 1, 1), box(2, 2, 3, 3)) == 0
    assert overlap.iou(HOLED, box(0, 0, 4, 4)) == pytest.approx(15 / 16)
    diamond = {"type": "Polygon", "coordinates": [[[1, 0], [2, 1], [1, 2], [0, 1], [1, 0]]]}
    assert overlap.iou(diamond, box(0, 0, 2, 2)) == pytest.approx(0.5)
    assert overlap.iou({"type": "MultiPolygon", "coordinates": [box(0, 0, 1, 1)["coordinates"], box(1, 0, 2, 1)["coordinates"]]}, box(0, 0, 2, 1)) == pytest.approx(1)
    assert overlap.safe_iou(json.dumps(LINE), json.dumps(SQUARE)) == 0 == overlap.safe_iou("nonsense", None)


VALIDITY = [
    (SQUARE, True, 5, []),
    (HOLED, True, 10, []),
    ({"type": "GeometryCollection"}, False, 0, ["invalid-geometry-collection"]),
    ({"type": "GeometryCollection", "geometries": []}, False, 0, ["empty-geometry-collection"]),
    (NESTED, True, 9, []),
    ({"type": "Point", "coordinates": [float("nan"), 0]}, False, 1, ["non-finite-coordinate"]),
    ({"type": "Point", "coordinates": [181, 0]}, False, 1, ["coordinate-outside-crs84"]),
    ({"type": "LineString", "coordinates": [[0, 0]]}, False, 1, ["linestring-too-short"]),
    ({"type": "LineString", "coordinates": [[179, 0], [-179, 0]]}, True, 2, ["antimeridian-crossing-not-cut"]),
    ({"type": "Polygon", "coordinates": [[[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]]]}, False, 5, ["polygon-ring-self-intersection"]),
    ({"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}, False, 4, ["polygon-ring-not-closed"]),
    ({"type": "Polygon", "coordinates": [HOLED["coordinates"][0], [[8, 8], [9, 8], [9, 9], [8, 8]]]}, False, 9, ["polygon-hole-outside-shell"]),
    ({"type": "Polygon", "coordinates": []}, False, 0, ["empty-geometry", "polygon-without-rings"]),
    ({"type": "Circle", "coordinates": [0, 0]}, False, 0, ["unsupported-geometry-type:Circle"]),
    ({"coordinates": [0, 0]}, False, 0, ["missing-or-invalid-geometry"]),
]


def test_validity(spark):
    df = spark.createDataFrame([(i, json.dumps(v[0], separators=(",", ":"))) for i, v in enumerate(VALIDITY)] + [(99, '{"type":"Point","coordinates":[1.5,2]}')], "i int, j string")
    got = {r.i: tuple(r.v) for r in df.select("i", overlap.validate(F.col("j")).alias("v")).collect()}
    for i, (shape, *want) in enumerate(VALIDITY):
        assert got[i] == tuple(want), shape
    assert got[99] == (True, 1, [])
    assert overlap.validity(SQUARE, 2)[2] == ["geometry-coordinate-limit-exceeded"]


def test_crs(spark):
    df = spark.createDataFrame([(json.dumps(g), c) for g, c in [({"type": "Point", "coordinates": [0, 0, 7]}, "epsg:3857"), (SQUARE, "EPSG:4326"), ({"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [20037508.342789244, 0]}]}, "EPSG:3857"), (None, "EPSG:3857")]], "j string, c string").replace("null", None)
    got = [None if r[0] is None else json.loads(r[0]) for r in df.select(crs.transform_geojson(F.col("j"), F.col("c"))).collect()]
    assert got[0]["coordinates"] == [0, 0, 7] and got[1] == SQUARE and got[2]["geometries"][0]["coordinates"][0] == pytest.approx(180) and got[3] is None
    with pytest.raises(Exception, match="unknown coordinate system"):
        spark.createDataFrame([(json.dumps(SQUARE), "EPSG:9999")], "j string, c string").select(crs.transform_geojson(F.col("j"), F.col("c"))).collect()
    assert crs.register_crs(" local:km ", crs.Crs(lambda x, y: (x * 100, y * 100), lambda x, y: (x / 100, y / 100))) == "LOCAL:KM" and crs.known_crs("local:KM")
    assert "LOCAL:KM" in crs.crs_snapshot()["registered"]
    with pytest.raises(TypeError):
        crs.register_crs("", None)


def test_text(spark):
    df = spark.createDataFrame([("Résumé – Café No. 5",), (None,), ("  ",)], "t string")
    assert [r[0] for r in df.select(text.normalized(F.col("t"))).collect()] == ["re sume cafe no 5", "", ""]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.canonical_json(F.lit('{"b": 1.0, "a": [1e-7, "é"]}'))) == '{"a":[1e-07,"é"],"b":1}'
    assert one(text.redact_url(F.lit("https://u:p@h/x?a=1&Token=zz&b=2#f"))) == "https://h/x?a=1&Token=REDACTED&b=2#f"
    assert one(text.value_type(F.lit("[1]"))) == "array" and one(text.plain(F.lit('"a\\"b"'))) == 'a"b' and one(text.quoted(F.lit('a"b'))) == '"a\\"b"'
    assert one(text.sha(F.lit("a"), F.lit("b"))) != one(text.sha(F.lit("ab"), F.lit("")))
