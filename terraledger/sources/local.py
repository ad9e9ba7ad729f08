"""Records in memory, JSON and GeoJSON files, and tables of records."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraledger.functions import crs, geometry
from terraledger.types import RAW, Limits, Request

from .base import Batch, Source, define, frame

_AXES = ("OGC:CRS84", "EPSG:4326")


def local_source(config: dict, ids: tuple[str, ...] = ()) -> Source:
    """Records given as dicts. Bounds filter only geometries in degrees; ids, where given, filter by source id."""
    records = config.get("records")
    if not config.get("id") or not isinstance(records, list):
        raise TypeError("a local source needs id and records")
    kept = json.loads(json.dumps(records))
    own_crs = str(config.get("sourceCrs") or "")

    def read(spark: SparkSession, request: Request, limits: Limits) -> Batch:
        df = frame(spark, kept)
        if ids:
            df = df.filter(F.col("source_id").isin(*ids))
        if request.bounds:
            system = F.upper(F.coalesce(F.nullif("source_crs", F.lit("")), F.lit(own_crs)))
            df = df.filter(F.col("geometry").isNull() | ~system.isin(*_AXES) | geometry.in_bounds(geometry.parse(F.col("geometry")), request.bounds))
        return Batch(df, "", request.bounds, "", str(config.get("retrievedAt") or ""), list(config.get("warnings") or []), {"request_count": 0, "transferred_bytes": 0, "from_cache": True})

    kinds = config.get("capabilities") or sorted({str(r.get("entityType") or r.get("entity_type")) for r in kept})
    return define({**config, "capabilities": kinds}, read, dataset_id=f"{config['id']}-local", dataset_version="1", operator="Local data author", query_modes=("bbox", "id"))


def table_source(config: dict, table: DataFrame) -> Source:
    """A table that has the raw columns (missing ones are null): the way to bring records at scale."""

    def read(spark: SparkSession, request: Request, limits: Limits) -> Batch:
        df = table.select(*[(F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW.fields])
        if request.bounds:
            df = df.filter(geometry.in_bounds(geometry.parse(F.col("geometry")), request.bounds))
        return Batch(df, "", request.bounds, metrics={"request_count": 0, "transferred_bytes": 0, "from_cache": True})

    return define(config, read, source_crs=crs.OUTPUT)


def file_source(config: dict) -> Source:
    """A JSON file: a FeatureCollection, a list of records, or an object with records. Read by Spark, so from any store.

    Features become records by fieldMap and publicFields (all fields where neither is given). Geometry
    is brought to degrees before bounds filter it; features without geometry pass. The path is
    nowhere in the output.
    """
    kinds = config.get("capabilities") or ([config["entityType"]] if config.get("entityType") else [])
    if not config.get("id") or not config.get("path") or not kinds:
        raise TypeError("a file source needs id, path, and capabilities or entityType")
    path = str(config["path"])
    most = max(1024, int(config.get("maxFileBytes") or 100 << 20))
    own_crs = str(config.get("sourceCrs") or crs.OUTPUT)

    def read(spark: SparkSession, request: Request, limits: Limits) -> Batch:
        whole = spark.read.text(path, wholetext=True)
        size = whole.agg(F.sum(F.octet_length("value"))).first()[0] or 0
        if size > most:
            raise ValueError("local file exceeds maxFileBytes")
        if whole.filter(F.try_parse_json("value").isNull()).count():
            raise SyntaxError("invalid JSON response: the file is no JSON document")
        shape = F.from_json("value", "type string, features array<string>, records array<string>")
        bare = F.ltrim("value").startswith("[")
        items = whole.select(
            F.when(bare, F.from_json("value", "array<string>")).when(shape["type"] == "FeatureCollection", shape["features"]).otherwise(shape["records"]).alias("items"),
            (~bare & F.coalesce(shape["type"] == "FeatureCollection", F.lit(False))).alias("is_feature"),
        )
        if items.filter("items is null").count():
            raise SyntaxError("a local file must hold a FeatureCollection, a list of records, or an object with records")
        opened = items.select("is_feature", F.posexplode("items").alias("at", "item"))
        df = features_to_raw(opened.filter("is_feature"), config).unionByName(records_to_raw(opened.filter("not is_feature")))
        if request.bounds:
            moved = crs.transform_geojson(F.col("geometry"), F.coalesce(F.nullif("source_crs", F.lit("")), F.lit(own_crs)))
            # Boxes are kept as a column, so that the filter does not repeat the parsing.
            df = df.withColumn("_b", geometry.bbox(geometry.parse(moved)))
            df = df.filter(F.col("geometry").isNull() | geometry.box_in(F.col("_b"), request.bounds)).drop("_b")
        df = df.withColumn("source_url", F.coalesce(F.nullif("source_url", F.lit("")), F.lit(str(config.get("sourceUrl") or "")))).withColumn("evidence_class", F.coalesce(F.nullif("evidence_class", F.lit("")), F.lit("DIRECT_SOURCE")))
        return Batch(df, "", request.bounds, str(config.get("sourceUrl") or ""), "", [], {"request_count": 0, "transferred_bytes": size, "from_cache": True})

    return define({**config, "capabilities": kinds}, read, dataset_id=PurePosixPath(path).name, dataset_version="local", source_crs=own_crs)


def features_to_raw(opened: DataFrame, config: dict) -> DataFrame:
    """Columns at, item (a GeoJSON feature) to raw records."""
    fields = config.get("fieldMap") or {}
    public = config.get("publicFields") or list(fields)
    name = lambda key, default: str(config.get(key) or default)
    id_field, kind_field = name("sourceIdField", "id"), name("entityTypeField", "_tl:entityType")
    f = F.from_json("item", "id string, geometry string, properties map<string,string>")
    raw_values = F.from_json(F.get_json_object("item", "$.properties"), "map<string,string>")
    # Values of a map of texts are plain; numbers, lists and objects keep their JSON form, texts are quoted again.
    as_json = F.from_json(F.get_json_object("item", "$.properties"), "map<string,variant>")
    df = opened.select(f.alias("f"), F.coalesce(raw_values, F.create_map().cast("map<string,string>")).alias("p"), F.transform_values(as_json, lambda k, v: F.to_json(v)).alias("j"))
    if public:
        pairs = F.array(*[F.struct(F.lit(fields.get(c, c)).alias("k"), F.col("j")[c].alias("v")) for c in public])
        props = F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull() & (x["v"] != "null")))
    else:
        props = F.map_filter("j", lambda k, v: ~k.isin(id_field, kind_field) & v.isNotNull() & (v != "null"))
    p = lambda key, default: F.col("p")[name(key, default)]
    gers = F.col("f.id") if config.get("featureIdIsGers") is True else p("gersField", "gers_id")
    values = {
        "source_id": F.coalesce("f.id", F.col("p")[id_field]),
        "entity_type": F.coalesce(F.lit(config.get("entityType")).cast("string"), F.col("p")[kind_field]),
        "source_crs": F.lit(str(config.get("sourceCrs") or crs.OUTPUT)),
        "geometry": F.nullif(F.col("f.geometry"), F.lit("null")),
        "properties": props,
        "aliases": F.from_json(p("aliasesField", "_tl:aliases"), "array<struct<namespace:string,id:string>>"),
        "gers_id": gers,
        "license_id": F.coalesce(p("licenseField", "_tl:licenseId"), F.lit(config.get("licenseId")).cast("string")),
        "attribution": F.coalesce(p("attributionField", "_tl:attribution"), F.lit(config.get("attribution")).cast("string")),
        "source_url": p("sourceUrlField", "_tl:sourceUrl"),
        "source_updated_at": p("updatedField", "updated_at"),
        "evidence_class": F.lit("DIRECT_SOURCE"),
    }
    return df.select(*[values.get(x.name, F.lit(None)).cast(x.dataType).alias(x.name) for x in RAW.fields])


_CAMEL = {"source_id": "sourceId", "entity_type": "entityType", "source_crs": "sourceCrs", "gers_id": "gersId", "dataset_version": "datasetVersion", "source_url": "sourceUrl", "license_id": "licenseId", "evidence_class": "evidenceClass", "retrieved_at": "retrievedAt", "observed_at": "observedAt", "valid_at": "validAt", "valid_from": "validFrom", "valid_to": "validTo", "source_updated_at": "sourceUpdatedAt"}


def records_to_raw(opened: DataFrame) -> DataFrame:
    """Columns at, item (a record as JSON) to raw records."""
    simple = [x.name for x in RAW.fields if x.dataType.simpleString() == "string" and x.name != "geometry"]
    values = {c: F.get_json_object("item", f"$.{_CAMEL.get(c, c)}") for c in simple}
    values["source_id"] = F.coalesce(values["source_id"], F.get_json_object("item", "$.id"))
    values["geometry"] = F.nullif(F.get_json_object("item", "$.geometry"), F.lit("null"))
    as_json = F.from_json(F.get_json_object("item", "$.properties"), "map<string,variant>")
    values["properties"] = F.transform_values(as_json, lambda k, v: F.to_json(v))
    values["aliases"] = F.from_json(F.get_json_object("item", "$.aliases"), "array<struct<namespace:string,id:string>>")
    values["warnings"] = F.from_json(F.get_json_object("item", "$.warnings"), "array<string>")
    act = F.from_json(F.get_json_object("item", "$.activity"), "id string, method string, version string, inputIds array<string>")
    values["activity"] = F.when(act["id"].isNotNull(), F.struct(act["id"].alias("id"), act["method"].alias("method"), act["version"].alias("version"), act["inputIds"].alias("input_ids")))
    return opened.select(*[values[x.name].cast(x.dataType).alias(x.name) for x in RAW.fields])


__all__ = ["local_source", "file_source", "table_source"]
