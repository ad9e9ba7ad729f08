"""Feature services over HTTP: a GeoJSON endpoint, OGC API Features, and ArcGIS feature layers."""

from __future__ import annotations

from urllib.parse import quote, urlencode, urljoin, urlsplit

from pyspark.sql import SparkSession

from terraledger.types import Limits, Request

from .base import Batch, Source, answer, define, get_json, http_url, mapped

_ACCEPT = {"Accept": "application/geo+json, application/json"}


def _clamp(value, default: int, most: int) -> int:
    return min(most, max(1, int(value or default)))


def _bbox(request: Request) -> str:
    return ",".join(f"{v:g}" if v == int(v) else repr(v) for v in request.bounds)


def _feature(f: dict, config: dict, url: str, fallback: str, crs: str) -> dict:
    props = f.get("properties") or {}
    given = f.get("id") if f.get("id") is not None else props.get(config.get("sourceIdField") or "id")
    return {
        "source_id": str(given if given is not None else fallback),
        "entity_type": config["entityType"],
        "source_crs": crs,
        "geometry": f.get("geometry"),
        "properties": mapped(props, config.get("fieldMap") or {}),
        "source_updated_at": props.get(config.get("updatedField") or "updated_at"),
        "source_url": url,
        "evidence_class": "DIRECT_SOURCE",
        "warnings": [] if given is not None else ["generated-source-id-from-response-order"],
    }


def suits(geometry: dict | None, entity_type: str) -> bool:
    """Whether a geometry's type is one for the entity type: points for places, lines for roads, polygons for all else."""
    kind = (geometry or {}).get("type")
    wanted = {"poi": ("Point", "MultiPoint"), "road": ("LineString", "MultiLineString")}.get(entity_type, ("Polygon", "MultiPolygon"))
    return kind in wanted


def geojson_source(config: dict) -> Source:
    """One GET of a FeatureCollection, with bbox added, or the URL that buildUrl(endpoint, request) gives."""
    if not all(config.get(k) for k in ("id", "endpoint", "entityType")):
        raise TypeError("a GeoJSON source needs id, endpoint and entityType")
    endpoint = http_url(config["endpoint"], "GeoJSON endpoint")
    crs = config.get("sourceCrs") or "OGC:CRS84"

    def read(spark: SparkSession, request: Request, limits: Limits) -> Batch:
        build = config.get("buildUrl")
        url = build(endpoint, request) if callable(build) else f"{endpoint}{'&' if '?' in endpoint else '?'}bbox={_bbox(request)}"
        doc, size = get_json(config, http_url(url, "GeoJSON request"), limits, headers=_ACCEPT, label="GeoJSON")
        if doc.get("type") != "FeatureCollection" or not isinstance(doc.get("features"), list):
            raise SyntaxError("invalid response: no FeatureCollection")
        good = [f for f in doc["features"] if suits(f.get("geometry"), config["entityType"])]
        return answer(spark, [_feature(f, config, url, f"feature-{i + 1}", crs) for i, f in enumerate(good)], request, url, size=size)

    return define({**config, "capabilities": [config["entityType"]]}, read, dataset_version="live", homepage=endpoint, source_crs=crs)


def ogc_source(config: dict) -> Source:
    """Pages of a collection by their next links, within a request budget and, unless allowed, one origin."""
    base = config.get("root") or config.get("baseUrl")  # the second is this engine's earlier name
    if not base or not all(config.get(k) for k in ("id", "collectionId", "entityType")):
        raise TypeError("an OGC API source needs id, root, collectionId and entityType")
    root = http_url(base, "OGC API").rstrip("/")
    items = f"{root}/collections/{quote(str(config['collectionId']), safe='')}"
    origin = lambda u: urlsplit(u)[:2]

    def read(spark: SparkSession, request: Request, limits: Limits) -> Batch:
        page, budget = _clamp(config.get("pageSize"), 500, 1000), _clamp(config.get("maxRequests"), 8, 32)
        url = f"{items}/items?bbox={_bbox(request)}&limit={page}&f=json"
        records, made, size = [], 0, 0
        while url and made < budget:
            doc, n = get_json(config, url, limits, headers=_ACCEPT, label="OGC API Features")
            made, size = made + 1, size + n
            if not isinstance(doc.get("features"), list):
                raise SyntaxError("invalid response: no features")
            for i, f in enumerate(doc["features"]):
                r = _feature(f, config, url, f"feature-{made}-{i + 1}", "OGC:CRS84")
                records.append({**r, "gers_id": (f.get("properties") or {}).get(config.get("gersField") or "gers_id")})
            after = next((x.get("href") for x in doc.get("links") or [] if x.get("rel") == "next"), "")
            after = http_url(urljoin(url, after), "next link") if after else ""
            if after and origin(after) != origin(root) and config.get("allowCrossOriginNext") is not True:
                raise RuntimeError("OGC API next link changed origin")
            url = after
        return answer(spark, records, request, items, exhausted=budget if url else 0, requests=made, size=size)

    return define({**config, "capabilities": [config["entityType"]]}, read, dataset_id=config["collectionId"], dataset_version="live", homepage=root, source_crs="OGC:CRS84")


def esri_geometry(g: dict | None, kind: str) -> dict | None:
    if not g:
        return None
    if kind == "esriGeometryPoint" or "x" in g:
        return {"type": "Point", "coordinates": [g["x"], g["y"]]}
    if kind == "esriGeometryPolygon" or "rings" in g:
        return {"type": "Polygon", "coordinates": g["rings"]}
    if kind == "esriGeometryPolyline" or "paths" in g:
        lines = g["paths"]
        return {"type": "LineString", "coordinates": lines[0]} if len(lines) == 1 else {"type": "MultiLineString", "coordinates": lines}
    raise TypeError(f"unsupported ArcGIS geometry: {kind}")


def arcgis_source(config: dict) -> Source:
    """A layer's metadata, then pages in order of the id field while the transfer limit is exceeded; metadata counts as a request."""
    if not all(config.get(k) for k in ("id", "layerUrl", "entityType")):
        raise TypeError("an ArcGIS source needs id, layerUrl and entityType")
    layer = http_url(config["layerUrl"], "ArcGIS layer").rstrip("/")
    public, key = list(dict.fromkeys(config.get("publicFields") or [])), str(config.get("sourceIdField") or "OBJECTID")
    names = {c: (config.get("fieldMap") or {}).get(c, c) for c in public}

    def read(spark: SparkSession, request: Request, limits: Limits) -> Batch:
        meta, size = get_json(config, f"{layer}?f=json", limits, label="ArcGIS metadata")
        page = _clamp(config.get("pageSize"), min(int(meta.get("maxRecordCount") or 500), 500), 2000)
        budget = _clamp(config.get("maxRequests"), 8, 32)
        records, offset, made, more = [], 0, 1, True
        while more and made < budget:
            query = {
                "f": "json", "where": config.get("where") or "1=1", "outFields": ",".join(dict.fromkeys([key, *public])), "returnGeometry": "true",
                "geometry": _bbox(request), "geometryType": "esriGeometryEnvelope", "spatialRel": "esriSpatialRelIntersects",
                "inSR": 4326, "outSR": 4326, "resultOffset": offset, "resultRecordCount": page, "orderByFields": key,
            }
            doc, n = get_json(config, f"{layer}/query?{urlencode(query)}", limits, label="ArcGIS query")
            made, size = made + 1, size + n
            if doc.get("error"):
                raise RuntimeError(f"ArcGIS query failed: {doc['error'].get('message') or doc['error'].get('code')}")
            for f in doc.get("features") or []:
                a = f.get("attributes") or {}
                records.append({"source_id": "" if a.get(key) is None else str(a[key]), "entity_type": config["entityType"], "source_crs": "EPSG:4326", "geometry": esri_geometry(f.get("geometry"), meta.get("geometryType")), "properties": mapped(a, names), "source_url": layer, "evidence_class": "DIRECT_SOURCE"})
            more, offset = doc.get("exceededTransferLimit") is True, offset + page
        return answer(spark, records, request, layer, exhausted=budget if more else 0, requests=made, size=size)

    return define({**config, "capabilities": [config["entityType"]]}, read, dataset_version="live", homepage=layer, source_crs="EPSG:4326")
