import json

import pytest
from pyspark.sql import functions as F

from terraledger.plans.synthesis import query_source
from terraledger.sources import base, openstreetmap, workflow
from terraledger.sources.base import Response, Source
from terraledger.sources.feature_services import arcgis_source, geojson_source, ogc_source
from terraledger.sources.local import file_source, local_source, table_source
from terraledger.sources.overture import overture_source
from terraledger.types import Limits, Request, SourceError, SynthesisError, validate_bounds

WORLD = Request((-10.0, -10.0, 10.0, 10.0))


def served(*bodies, status=200):
    calls, queue = [], list(bodies)

    def fetch(url, headers, body, timeout, most):
        calls.append((url, body))
        x = queue.pop(0)
        return Response(status, x if isinstance(x, bytes) else (x if isinstance(x, str) else json.dumps(x)).encode())

    return fetch, calls


def rows(spark, source, request=WORLD, limits=Limits()):
    b = source.read(spark, request, limits)
    return b, {r.source_id: r for r in b.records.collect()}


def feature(i, geometry, **props):
    return {"type": "Feature", **({"id": i} if i is not None else {}), "geometry": geometry, "properties": props}


POINT = {"type": "Point", "coordinates": [1, 2]}


def test_geojson(spark):
    fetch, calls = served({"type": "FeatureCollection", "features": [feature("a", POINT, title="A", secret=1), feature(None, POINT, title=None), feature("line", {"type": "LineString", "coordinates": [[0, 0], [1, 1]]})]})
    b, got = rows(spark, geojson_source({"id": "g", "endpoint": "https://h/x?k=1", "entityType": "poi", "fieldMap": {"title": "name"}, "fetch": fetch}))
    assert calls[0][0] == "https://h/x?k=1&bbox=-10,-10,10,10"
    assert set(got) == {"a", "feature-2"} and got["a"].properties == {"name": '"A"'} and got["feature-2"].warnings == ["generated-source-id-from-response-order"]
    for bad in ("{", {"type": "Feature"}):
        fetch, _ = served(bad)
        with pytest.raises(SourceError) as e:
            query_source(spark, geojson_source({"id": "g", "endpoint": "https://h", "entityType": "poi", "fetch": fetch}), WORLD)
        assert e.value.status == "invalid_response"
    with pytest.raises(TypeError):
        geojson_source({"id": "g", "endpoint": "ftp://h", "entityType": "poi"})


def test_http_guards(spark):
    big, _ = served(b"x" * 3000)
    with pytest.raises(ValueError, match="exceeds 1024"):
        base.get_text({"fetch": big, "maxResponseBytes": 10}, "https://h", Limits())
    for status, want in ((429, "rate_limited"), (503, "unavailable")):
        fetch, _ = served("nope token=x", status=status)
        with pytest.raises(SourceError) as e:
            query_source(spark, geojson_source({"id": "g", "endpoint": "https://h", "entityType": "poi", "fetch": fetch}), WORLD)
        assert e.value.status == want and e.value.to_json()["code"] == f"PROVIDER_{want.upper()}"
    assert base.classify(TimeoutError()) == "timeout"
    assert base.safe_message("see https://u:p@h/?sig=abc Bearer a.b") == "see https://h/?sig=REDACTED Bearer REDACTED"


def test_ogc_pages(spark):
    page = lambda i, after: {"features": [feature(i, POINT, n=i, gers_id=f"g{i}")], "links": [{"rel": "next", "href": after}] if after else []}
    config = {"id": "o", "baseUrl": "https://h/api/", "collectionId": "c", "entityType": "poi", "fieldMap": {"n": "name"}}
    fetch, calls = served(page("1", "/api/next"), page("2", None))
    b, got = rows(spark, ogc_source({**config, "fetch": fetch}))
    assert set(got) == {"1", "2"} and got["2"].gers_id == "g2" and b.status == "available" and calls[1][0] == "https://h/api/next"
    fetch, _ = served(page("1", "/api/next"))
    b, _ = rows(spark, ogc_source({**config, "fetch": fetch, "maxRequests": 1}))
    assert b.status == "partial" and b.warnings == ["request-budget-exhausted:1"]
    fetch, _ = served(page("1", "https://other/next"))
    with pytest.raises(RuntimeError, match="origin"):
        ogc_source({**config, "fetch": fetch}).read(spark, WORLD, Limits())


def test_arcgis_pages(spark):
    f = lambda i: {"attributes": {"OBJECTID": i, "NAME": f"n{i}", "X": 1}, "geometry": {"x": i, "y": 0}}
    fetch, calls = served({"geometryType": "esriGeometryPoint", "maxRecordCount": 1}, {"features": [f(1)], "exceededTransferLimit": True}, {"features": [f(2)]})
    b, got = rows(spark, arcgis_source({"id": "a", "layerUrl": "https://h/0/", "entityType": "poi", "publicFields": ["NAME"], "fieldMap": {"NAME": "name"}, "where": "A=1", "fetch": fetch}))
    assert set(got) == {"1", "2"} and got["1"].properties == {"name": '"n1"'} and json.loads(got["2"].geometry)["coordinates"] == [2, 0]
    assert "where=A%3D1" in calls[1][0] and "resultOffset=1" in calls[2][0] and b.metrics["request_count"] == 3


OSM = {
    "elements": [
        {"type": "node", "id": 1, "lon": 1, "lat": 1, "tags": {"shop": "bakery", "name": "B\"x", "addr:housenumber": "", "addr:street": "S"}},
        {"type": "node", "id": 1, "lon": 9, "lat": 9, "tags": {"shop": "again"}},
        {"type": "way", "id": 2, "tags": {"building": "yes", "building:levels": "3"}, "geometry": [{"lon": 0, "lat": 0}, {"lon": 1, "lat": 0}, {"lon": 1, "lat": 1}, {"lon": 0, "lat": 0}]},
        {"type": "way", "id": 3, "tags": {"highway": "x"}, "geometry": [{"lon": 0, "lat": 0}, {"lon": 1, "lat": 0}, {"lon": 1, "lat": 1}, {"lon": 0, "lat": 0}]},
        {"type": "relation", "id": 4, "tags": {"landuse": "forest"}},
        {"type": "relation", "id": 5, "tags": {"amenity": "school"}, "center": {"lon": 3, "lat": 4}},
        {"type": "node", "id": 6, "lon": 1, "lat": 1, "tags": {"building": "no"}},
    ]
}


def test_overpass(spark):
    fetch, calls = served(OSM)
    b, got = rows(spark, openstreetmap.overpass_source({"id": "osm", "fetch": fetch, "tagMap": {"shop": "kind"}}))
    assert set(got) == {"node/1", "way/2", "way/3", "relation/5"} and b.warnings == ["unsupported-or-missing-geometry:1"]
    assert got["node/1"].properties == {"name": '"B\\"x"', "type": '"bakery"', "category": '"bakery"', "address": '"S"', "kind": '"bakery"'}
    assert json.loads(got["way/2"].geometry)["type"] == "Polygon" and got["way/3"].warnings == ["closed-way-retained-as-line"]
    assert got["relation/5"].warnings == ["relation-or-way-center-used"] and got["way/2"].entity_type == "building"
    assert b"nwr%5B%22building%22%5D%28-10%2C-10%2C10%2C10%29" in calls[0][1]
    fetch, _ = served({"remark": "runtime error: timed out", "elements": []})
    with pytest.raises(SourceError) as e:
        query_source(spark, openstreetmap.overpass_source({"id": "osm", "fetch": fetch}), WORLD)
    assert e.value.status == "timeout"


XML = """<osm><node id="1" lon="0" lat="0"/><node id="2" lon="1" lat="0"/><node id="3" lon="1" lat="1"/><node id="4" lon="5" lat="5" timestamp="2026"><tag k="shop" v="a &amp; b"/></node>
<way id="7"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><nd ref="99"/><tag k="building" v="yes"/></way><way id="8"><nd ref="1"/><nd ref="3"/><tag k="amenity" v="school"/></way><way id="9"><nd ref="1"/><tag k="highway" v="x"/></way><relation id="1"/></osm>"""


def test_map_xml(spark, tmp_path):
    fetch, _ = served(XML)
    b, got = rows(spark, openstreetmap.map_source({"id": "m", "fetch": fetch, "maxBboxAreaDegrees2": 1000}))
    shape = {k: json.loads(r.geometry) for k, r in got.items()}
    assert set(got) == {"node/4", "way/7", "way/8"} and b.warnings == ["relation-geometry-not-reconstructed:1"]
    assert shape["way/7"] == {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]} and shape["way/8"]["coordinates"] == [0.5, 0.5]
    with pytest.raises(ValueError):
        openstreetmap.map_source({"id": "m", "fetch": fetch}).read(spark, WORLD, Limits())
    (tmp_path / "x.osm").write_text(XML)
    nodes, ways, relations = openstreetmap.read_xml(spark, str(tmp_path / "x.osm"))
    again = openstreetmap.from_tables(nodes, ways, openstreetmap.CAPABILITIES)
    assert {r.source_id: json.loads(r.geometry) for r in again.collect()} == shape and relations.count() == 1


def test_files(spark, tmp_path):
    near, far = feature("in", POINT, title="A", n=1.5, updated_at="2026", **{"_tl:licenseId": "L"}), feature("out", {"type": "Point", "coordinates": [50, 50]}, title="B")
    path = tmp_path / "f.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [near, far, feature("bare", None, title="C")]}))
    config = {"id": "f", "path": str(path), "entityType": "poi"}
    _, got = rows(spark, file_source({**config, "publicFields": ["title", "n"], "fieldMap": {"title": "name"}}))
    assert set(got) == {"in", "bare"} and got["in"].properties == {"name": '"A"', "n": "1.5"} and got["in"].license_id == "L" and got["in"].source_updated_at == "2026"
    records, _ = query_source(spark, file_source(config), WORLD)
    assert str(path) not in str(records.collect())
    for doc in ([{"sourceId": "r", "entityType": "poi", "properties": {"a": {"b": [1]}}}], {"records": [{"id": "r", "entityType": "poi", "aliases": [{"namespace": "n", "id": "1"}]}]}):
        path.write_text(json.dumps(doc))
        _, got = rows(spark, file_source(config))
        assert set(got) == {"r"}
    path.write_text("{")
    with pytest.raises(SourceError):
        query_source(spark, file_source(config), WORLD)


def test_limits_and_bad_records(spark):
    many = [{"sourceId": f"r{i}", "entityType": "poi", "geometry": {"type": "Point", "coordinates": [i, 0]}} for i in range(5)]
    s = local_source({"id": "s", "records": many, "sourceCrs": "OGC:CRS84"})
    got, row = query_source(spark, s, WORLD, Limits(max_records=2))
    assert got.count() == 2 and row["status"] == "partial" and row["warnings"] == ["record-limit-exceeded:2"]
    got, row = query_source(spark, s, Request((2.5, -1, 9, 1)))
    assert sorted(r.source_id for r in got.collect()) == ["r3", "r4"] and row["status"] == "available"
    assert query_source(spark, s, Request((20, 20, 21, 21)))[1]["status"] == "authoritative-empty"
    for bad in ({"sourceId": "x", "entityType": "dragon"}, {"sourceId": "", "entityType": "poi"}, {"sourceId": "r0", "entityType": "poi"}, {"sourceId": "x", "entityType": "poi", "properties": {f"p{i}": 1 for i in range(300)}}, {"sourceId": "x", "entityType": "poi", "sourceCrs": "EPSG:1", "geometry": POINT}):
        with pytest.raises(SourceError) as e:
            query_source(spark, local_source({"id": "s", "records": [*many, bad], "sourceCrs": "OGC:CRS84", "capabilities": ["poi"]}), Request())
        assert e.value.status == "invalid_response"
    bow = {"sourceId": "b", "entityType": "parcel", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]]]}}
    r = query_source(spark, local_source({"id": "s", "records": [bow], "sourceCrs": "OGC:CRS84"}), Request())[0].first()
    assert r.geometry is None and r.rejected_geometry and r.provenance.warnings == ["polygon-ring-self-intersection"]
    with pytest.raises(TypeError):
        local_source({"id": "s", "records": [{"sourceId": "x", "entityType": "poi", "properties": {"a": float("inf")}}], "sourceCrs": "OGC:CRS84", "capabilities": ["poi"]}).read(spark, Request(), Limits())
    with pytest.raises(TypeError):
        Source("x", lambda *a: None, ("dragon",))


def test_table_source(spark):
    t = spark.range(4).select(F.col("id").cast("string").alias("source_id"), F.lit("poi").alias("entity_type"), F.format_string('{"type":"Point","coordinates":[%d,0]}', "id").alias("geometry"))
    got, _ = query_source(spark, table_source({"id": "t", "capabilities": ["poi"]}, t), Request((1.5, -1, 9, 1)))
    assert sorted(r.source_id for r in got.collect()) == ["2", "3"]


def test_overture(spark, tmp_path):
    sources = [{"dataset": "OpenStreetMap", "record_id": "w5@2", "update_time": "2025", "license": "ODbL-1.0"}, {"dataset": "Other", "record_id": "z", "update_time": "2026"}]
    doc = {"type": "FeatureCollection", "features": [feature("gers-1", POINT, names={"primary": "Hall"}, height=12.0, num_floors=3, sources=sources)]}

    def download(config, bounds, target, timeout):
        with open(target, "w") as f:
            json.dump(doc, f)

    _, got = rows(spark, overture_source({"id": "o", "release": "2026-01-21.0", "download": download}))
    r = got["gers-1"]
    assert r.gers_id == "gers-1" and r.source_updated_at == "2026" and r.license_id == "ODbL-1.0" and r.attribution == "OpenStreetMap; Other; Overture Maps Foundation"
    assert [(a.namespace, a.id) for a in r.aliases] == [("openstreetmap", "way/5"), ("overture-source:Other", "z")] and r.properties["height"] == "12" and r.properties["levels"] == "3"
    with pytest.raises(TypeError):
        overture_source({"id": "o", "release": "latest"})


def test_cache(spark, tmp_path):
    calls = []
    inner = local_source({"id": "s", "records": [{"sourceId": "a", "entityType": "poi"}], "sourceCrs": "OGC:CRS84"})
    counted = base.replace(inner, read=lambda *a: calls.append(1) or inner.read(*a))
    clock = [0.0]
    s = workflow.with_cache(counted, workflow.ParquetCache(spark, f"file://{tmp_path}/cache"), 100, now=lambda: clock[0])
    assert s.read(spark, WORLD, Limits()).metrics["from_cache"] is True and len(calls) == 1  # a local source says so itself
    assert s.read(spark, WORLD, Limits()).records.count() == 1 and len(calls) == 1
    s.read(spark, Request((0, 0, 1, 1)), Limits())
    assert len(calls) == 2
    clock[0] = 1000
    s.read(spark, WORLD, Limits())
    assert len(calls) == 3


def test_workflow(tmp_path, monkeypatch):
    (tmp_path / "w.json").write_text(json.dumps({"bounds": [0, 0, 1, 1], "providers": [{"type": "local-file", "id": "${NAME_X}", "path": "p.json", "entityType": "poi"}]}))
    with pytest.raises(KeyError):
        workflow.load_workflow(str(tmp_path / "w.json"))
    monkeypatch.setenv("NAME_X", "places")
    assert workflow.load_workflow(str(tmp_path / "w.json"))["providers"][0].id == "places"
    (tmp_path / "w.json").write_text(json.dumps({"providers": [{"type": "magic"}]}))
    with pytest.raises(TypeError, match="unknown provider type"):
        workflow.load_workflow(str(tmp_path / "w.json"))


def test_bounds_and_limits():
    assert validate_bounds([None, 0, 1, "2"]) == (0, 0, 1, 2)
    for bad in ([0, 0, 0, 1], [0, 0, 181, 1], [0, 5, 1, 4]):
        with pytest.raises(ValueError):
            validate_bounds(bad)
    for bad in (None, [1, 2, 3], ["a", 0, 1, 1], [0, 0, float("nan"), 1]):
        with pytest.raises(TypeError):
            validate_bounds(bad)
    assert Limits.of({"max_records": 0, "timeout_ms": -5, "max_property_bytes": 1}) == Limits(timeout_ms=0, max_property_bytes=1024)
    assert SynthesisError("x", "C", {"a": 1}).to_json() == {"name": "SynthesisError", "code": "C", "message": "x", "details": {"a": 1}}
