"""OpenStreetMap: tags classified and projected by column functions, ways rebuilt by joins, and two services."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraledger.functions import text
from terraledger.types import RAW, Limits, Request

from .base import Batch, Source, define, get_json, get_text, http_url

# Types offered, selectors of each, and tags that make a place.
CAPABILITIES = ("address", "building", "landuse", "poi", "road", "water")
SELECTORS = {
    "building": ('nwr["building"]',),
    "poi": ('nwr["amenity"]', 'nwr["shop"]', 'nwr["tourism"]', 'nwr["leisure"]', 'nwr["office"]', 'nwr["craft"]'),
    "address": ('nwr["addr:housenumber"]',),
    "road": ('way["highway"]',),
    "landuse": ('nwr["landuse"]',),
    "water": ('nwr["natural"="water"]', 'way["waterway"]'),
}
PLACE_TAGS = ("amenity", "shop", "tourism", "leisure", "office", "craft")
TYPE_TAGS = ("building", "amenity", "shop", "tourism", "landuse", "waterway")
ADDRESS_TAGS = ("addr:housenumber", "addr:street", "addr:city", "addr:postcode")
DIRECT_TAGS = {"name": "name", "class": "highway", "height": "height", "levels": "building:levels", "roofShape": "roof:shape", "reference": "ref"}
LICENSE, CREDIT = "ODbL-1.0", "© OpenStreetMap contributors"


def _tag(tags: Column, name: str) -> Column:
    return F.nullif(tags[name], F.lit(""))


def classify(tags: Column) -> Column:
    """The entity type of a tag map; empty where none fits."""
    has = lambda n: _tag(tags, n).isNotNull()
    place = F.coalesce(*[_tag(tags, n) for n in PLACE_TAGS]).isNotNull()
    return (
        F.when(has("building") & (tags["building"] != "no"), "building")
        .when(has("highway"), "road")
        .when(has("addr:housenumber"), "address")
        .when(place, "poi")
        .when(has("landuse"), "landuse")
        .when(F.coalesce(tags["natural"] == "water", F.lit(False)) | has("waterway"), "water")
        .otherwise("")
    )


def properties(tags: Column, tag_map: dict[str, str] | None = None) -> Column:
    """The default properties of a tag map as JSON values; tag_map adds or replaces properties by tags."""
    full = F.coalesce(_tag(tags, "addr:full"), F.nullif(F.concat_ws(" ", *[_tag(tags, n) for n in ADDRESS_TAGS]), F.lit("")))
    values = {p: _tag(tags, t) for p, t in DIRECT_TAGS.items()}
    values |= {"type": F.coalesce(*[_tag(tags, t) for t in TYPE_TAGS]), "category": F.coalesce(*[_tag(tags, t) for t in PLACE_TAGS]), "address": full}
    for tag, prop in (tag_map or {}).items():
        values[prop] = F.coalesce(_tag(tags, tag), values.get(prop, F.lit(None).cast("string")))
    pairs = F.array(*[F.struct(F.lit(p).alias("k"), text.quoted(v).alias("v")) for p, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))


def _geometry(kind: str, coords: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")))


def _closed(c: Column) -> Column:
    return (F.size(c) >= 4) & (F.get(c, 0) == F.element_at(c, -1))


def to_raw(elements: DataFrame, requested: tuple[str, ...], tag_map: dict | None, keep_bare: bool = False, centre_ways: bool = False) -> DataFrame:
    """Raw records of elements (kind, id, tags, lon, lat, coords, center, timestamp), one for each kind and id.

    With centre_ways a way that is a place or address is its box's middle and only buildings, land use
    and standing water are areas; without, any closed way but roads and streams is an area, and the
    centre that the service gives stands in for geometry that it does not.
    """
    e = elements.withColumn("sid", F.concat_ws("/", "kind", "id")).withColumn("entity_type", classify(F.col("tags"))).filter(F.col("entity_type").isin(*requested))
    t, c = F.col("entity_type"), F.col("coords")
    standing = (t == "water") & F.coalesce(F.col("tags")["natural"] == "water", F.lit(False))
    way, spot = (F.col("kind") == "way") & (F.size(c) >= 2), t.isin("poi", "address")
    xs, ys = F.transform(c, lambda p: p[0]), F.transform(c, lambda p: p[1])
    middle = F.array((F.array_min(xs) + F.array_max(xs)) / 2, (F.array_min(ys) + F.array_max(ys)) / 2)
    areal = _closed(c) & ((t.isin("building", "landuse") | standing) if centre_ways else (standing | ~t.isin("road", "water")))
    node = (F.col("kind") == "node") & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    geo = F.when(node, _geometry("Point", F.array("lon", "lat"))).when(way & areal, _geometry("Polygon", F.array(c)))
    note = F.when(node | (way & areal), F.lit(None).cast("string"))
    if centre_ways:
        geo, note = geo.when(way & spot, _geometry("Point", middle)), note.when(way & spot, "way-bbox-center-used")
    geo, note = geo.when(way, _geometry("LineString", c)), note.when(way & _closed(c), "closed-way-retained-as-line").when(way, None)
    given = spot & F.col("center").isNotNull()
    geo = geo.when(given, _geometry("Point", F.col("center")))
    note = note.when(given, "relation-or-way-center-used").when(F.col("kind") == "relation", "relation-geometry-not-reconstructed").otherwise("missing-element-geometry")
    e = e.withColumn("geometry", geo).withColumn("note", note)
    if not keep_bare:
        e = e.filter("geometry is not null")
    values = {
        "source_id": F.col("sid"),
        "entity_type": t,
        "source_crs": F.lit("OGC:CRS84"),
        "geometry": F.col("geometry"),
        "properties": properties(F.col("tags"), tag_map),
        "aliases": F.array(F.struct(F.lit("openstreetmap").alias("namespace"), F.col("sid").alias("id"))),
        "source_url": F.concat(F.lit("https://www.openstreetmap.org/"), F.col("sid")),
        "source_updated_at": F.col("timestamp"),
        "evidence_class": F.lit("DIRECT_SOURCE"),
        "warnings": F.array_compact(F.array("note")),
    }
    return e.select(*[values.get(x.name, F.lit(None)).cast(x.dataType).alias(x.name) for x in RAW.fields])


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, coords) of ways (id, refs) over nodes (id, lon, lat): positions in order, references without a node left out."""
    refs = ways.select("id", F.posexplode("refs").alias("at", "ref"))
    found = refs.join(nodes.select(F.col("id").alias("ref"), "lon", "lat"), "ref")
    return found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"])).alias("coords"))


def from_tables(nodes: DataFrame, ways: DataFrame, requested: tuple[str, ...], tag_map: dict | None = None) -> DataFrame:
    """Raw records of nodes (id, lon, lat, tags, timestamp) and ways (id, refs, tags, timestamp)."""
    none = F.lit(None)
    line, pair = "array<array<double>>", "array<double>"
    a = nodes.select(F.lit("node").alias("kind"), "id", "tags", "lon", "lat", none.cast(line).alias("coords"), none.cast(pair).alias("center"), "timestamp")
    tagged = ways.filter(classify(F.col("tags")) != "")
    b = tagged.join(way_lines(tagged, nodes), "id").select(F.lit("way").alias("kind"), "id", "tags", none.cast("double").alias("lon"), none.cast("double").alias("lat"), "coords", none.cast(pair).alias("center"), "timestamp")
    return to_raw(a.unionByName(b), requested, tag_map, centre_ways=True)


NODES = "id string, lon double, lat double, tags map<string,string>, timestamp string"
WAYS = "id string, refs array<string>, tags map<string,string>, timestamp string"


def read_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) of OSM XML files, read in parallel by Spark's XML reader."""
    tag = "tag array<struct<_k:string,_v:string>>"
    read = lambda row, schema: spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda x: F.struct(x["_k"].alias("k"), F.coalesce(x["_v"], F.lit("")).alias("v"))))
    nodes = read("node", f"_id string, _lon double, _lat double, _timestamp string, {tag}").select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), tags.alias("tags"), F.col("_timestamp").alias("timestamp"))
    ways = read("way", f"_id string, _timestamp string, nd array<struct<_ref:string>>, {tag}").select(F.col("_id").alias("id"), F.col("nd._ref").alias("refs"), tags.alias("tags"), F.col("_timestamp").alias("timestamp"))
    return nodes, ways, read("relation", "_id string")


def _source(config: dict, read, endpoint: str) -> Source:
    kinds = tuple(dict.fromkeys(config.get("capabilities") or CAPABILITIES))
    if not config.get("id"):
        raise TypeError("an OpenStreetMap source needs an id")
    if any(k not in CAPABILITIES for k in kinds):
        raise TypeError(f"OpenStreetMap capabilities are: {', '.join(CAPABILITIES)}")
    http_url(endpoint, "OpenStreetMap endpoint")
    fixed = {**config, "capabilities": kinds, "licenseId": LICENSE, "queryModes": ["bbox"], "sourceCrs": "OGC:CRS84"}
    return define(fixed, read, dataset_id="openstreetmap", dataset_version="live", operator="OpenStreetMap contributors", attribution=CREDIT, homepage="https://www.openstreetmap.org/copyright")


def _wanted(config: dict, request: Request) -> tuple[str, ...]:
    kinds = tuple(dict.fromkeys(config.get("capabilities") or CAPABILITIES))
    return tuple(k for k in kinds if not request.entity_types or k in request.entity_types)


def overpass_query(bounds, kinds: tuple[str, ...], timeout: int, size: int) -> str:
    w, s, e, n = bounds
    clauses = list(dict.fromkeys(c for k in kinds for c in SELECTORS[k]))
    body = "\n".join(f"  {c}({s:g},{w:g},{n:g},{e:g});" for c in clauses)
    return f"[out:json][timeout:{timeout}][maxsize:{size}];\n(\n{body}\n);\nout tags center geom qt;"


def overpass_source(config: dict) -> Source:
    """The Overpass service: one query for the wanted types; each element once; what has no geometry is counted, or kept if asked for."""
    endpoint = str(config.get("endpoint") or "https://overpass-api.de/api/interpreter")

    def read(spark: SparkSession, request: Request, limits: Limits) -> Batch:
        kinds = _wanted(config, request)
        timeout = min(180, max(5, int(config.get("queryTimeoutSeconds") or 25)))
        size = min(256 << 20, max(1 << 20, int(config.get("queryMaxSizeBytes") or 64 << 20)))
        body = urlencode({"data": overpass_query(request.bounds, kinds, timeout, size)}).encode()
        doc, got = get_json(config, endpoint, limits, headers={"Accept": "application/json", "Content-Type": "application/x-www-form-urlencoded;charset=UTF-8"}, body=body, label="Overpass")
        if re.search(r"runtime error|timed? out|rate.?limit|too many requests", str(doc.get("remark") or ""), re.I):
            raise RuntimeError(f"Overpass runtime error: {doc['remark']}")
        if not isinstance(doc.get("elements"), list):
            raise SyntaxError("invalid Overpass response: no elements")
        rows, seen = [], set()
        number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
        for x in doc["elements"]:
            if (key := (x.get("type"), str(x.get("id")))) in seen:
                continue
            seen.add(key)
            line = [[number(p.get("lon")), number(p.get("lat"))] for p in x.get("geometry") or [] if p]
            mid = x.get("center") or {}
            rows.append((*key, {k: str(v) for k, v in (x.get("tags") or {}).items()}, number(x.get("lon")), number(x.get("lat")), [p for p in line if None not in p], [number(mid.get("lon")), number(mid.get("lat"))] if mid else None, x.get("timestamp")))
        elements = spark.createDataFrame(rows, "kind string, id string, tags map<string,string>, lon double, lat double, coords array<array<double>>, center array<double>, timestamp string")
        every = to_raw(elements, kinds, config.get("tagMap"), keep_bare=True)
        bare = every.filter("geometry is null").count()
        keep = config.get("includeGeometryless") is True
        notes = [f"unsupported-or-missing-geometry:{bare}"] if bare and not keep else []
        return Batch(every if keep else every.filter("geometry is not null"), "", request.bounds, endpoint, "", notes, {"request_count": 1, "transferred_bytes": got, "from_cache": False})

    return _source(config, read, endpoint)


def map_source(config: dict) -> Source:
    """The map service's XML of a box of limited area; relations are counted, not built."""
    endpoint = str(config.get("endpoint") or "https://api.openstreetmap.org/api/0.6/map")

    def read(spark: SparkSession, request: Request, limits: Limits) -> Batch:
        w, s, e, n = request.bounds
        if (e - w) * (n - s) > max(1e-6, float(config.get("maxBboxAreaDegrees2") or 0.25)):
            raise ValueError("the box is larger than the map service may be asked for")
        url = f"{endpoint}?{urlencode({'bbox': f'{w:g},{s:g},{e:g},{n:g}'})}"
        body = get_text(config, url, limits, headers={"Accept": "application/xml"}, label="OpenStreetMap API", default_bytes=50 << 20)
        try:
            root = ET.fromstring(body)  # noqa: S314
        except ET.ParseError as err:
            raise SyntaxError(f"invalid OpenStreetMap XML: {err}") from None
        if root.tag != "osm":
            raise SyntaxError("invalid OpenStreetMap XML: no osm root")
        tags = lambda x: {t.get("k"): t.get("v") or "" for t in x.iter("tag") if t.get("k")}
        nodes = spark.createDataFrame([(x.get("id"), float(x.get("lon")), float(x.get("lat")), tags(x), x.get("timestamp")) for x in root.iter("node") if x.get("lon") and x.get("lat")], NODES)
        ways = spark.createDataFrame([(x.get("id"), [r.get("ref") for r in x.iter("nd")], tags(x), x.get("timestamp")) for x in root.iter("way")], WAYS)
        relations = sum(1 for _ in root.iter("relation"))
        notes = [f"relation-geometry-not-reconstructed:{relations}"] if relations else []
        return Batch(from_tables(nodes, ways, _wanted(config, request), config.get("tagMap")), "", request.bounds, url, "", notes, {"request_count": 1, "transferred_bytes": len(body.encode()), "from_cache": False})

    return _source(config, read, endpoint)
