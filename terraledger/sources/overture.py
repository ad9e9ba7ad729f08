"""Buildings of a pinned release of a map distribution whose feature ids are stable across releases."""

from __future__ import annotations

import re
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from terraledger.functions import geometry
from terraledger.types import RAW, Limits, Request

from .base import Batch, Source, define

RELEASE = re.compile(r"^\d{4}-\d{2}-\d{2}\.\d+$")
_SOURCES = "array<struct<dataset:string,record_id:string,update_time:string,license:string>>"
_OSM = r"^([nwr])(\d+)@"
KIND = {"n": "node", "w": "way", "r": "relation"}


def _osm(s: Column) -> Column:
    """node/1 of an upstream record id n1@3; null for others."""
    kind = F.create_map(*[F.lit(v) for kv in KIND.items() for v in kv])[F.regexp_extract(s["record_id"], _OSM, 1)]
    return F.when((s["dataset"] == "OpenStreetMap") & s["record_id"].rlike(_OSM), F.concat_ws("/", kind, F.regexp_extract(s["record_id"], _OSM, 2)))


def features(df, aliases: bool = True):
    """Raw records of a column item with GeoJSON building features."""
    f = F.from_json("item", f"id string, geometry string, properties struct<names:struct<primary:string>,height:double,num_floors:int,subtype:string,class:string,sources:{_SOURCES}>")
    d = df.select(f.alias("f"), F.get_json_object("item", "$.properties.sources").alias("raw_sources")).withColumn("p", F.col("f.properties"))
    d = d.withColumn("src", F.coalesce("p.sources", F.array().cast(_SOURCES)))
    number = lambda c: F.when(F.col(c).isNotNull(), F.regexp_replace(F.to_json(F.array(c)), r"^\[|(\.0)?\]$", ""))
    quoted = lambda c: F.when(F.col(c).isNotNull(), F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1))
    pairs = {"name": quoted("p.names.primary"), "height": number("p.height"), "levels": number("p.num_floors"), "type": quoted("p.subtype"), "class": quoted("p.class"), "upstreamSources": F.coalesce("raw_sources", F.lit("[]"))}
    props = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs.items()]), lambda x: x["v"].isNotNull()))
    alias = lambda s: F.when(F.coalesce(s["record_id"], F.lit("")) != "", F.when(_osm(s).isNotNull(), F.struct(F.lit("openstreetmap").alias("namespace"), _osm(s).alias("id"))).when(s["dataset"].isNotNull(), F.struct(F.concat(F.lit("overture-source:"), s["dataset"]).alias("namespace"), s["record_id"].alias("id"))))
    named = F.array_distinct(F.array_compact(F.transform("src", alias))) if aliases else F.array().cast("array<struct<namespace:string,id:string>>")
    licences = F.array_distinct(F.array_compact(F.transform("src", lambda s: F.nullif(s["license"], F.lit("")))))
    credits = F.array_distinct(F.concat(F.array_compact(F.transform("src", lambda s: F.nullif(s["dataset"], F.lit("")))), F.array(F.lit("Overture Maps Foundation"))))
    first = F.get(F.array_compact(F.transform("src", _osm)), 0)
    values = {
        "source_id": F.when(F.col("f.id").isNull(), F.raise_error(F.lit("a building feature has no stable id")).cast("string")).otherwise(F.col("f.id")),
        "entity_type": F.lit("building"),
        "source_crs": F.lit("OGC:CRS84"),
        "geometry": F.nullif(F.col("f.geometry"), F.lit("null")),
        "properties": props,
        "aliases": named,
        "gers_id": F.col("f.id"),
        "license_id": F.when(F.size(licences) == 1, F.get(licences, 0)).otherwise("ODbL-1.0"),
        "attribution": F.array_join(credits, "; "),
        "source_url": F.coalesce(F.concat(F.lit("https://www.openstreetmap.org/"), first), F.lit("https://docs.overturemaps.org/attribution/")),
        "source_updated_at": F.array_max(F.transform("src", lambda s: F.nullif(s["update_time"], F.lit("")))),
        "evidence_class": F.lit("DIRECT_SOURCE"),
    }
    return d.select(*[values.get(x.name, F.lit(None)).cast(x.dataType).alias(x.name) for x in RAW.fields])


def overture_source(config: dict) -> Source:
    """Buildings of a pinned release, by the distribution's own download command, or from path: GeoJSON lines already at hand.

    download(config, bounds, target, timeout) may replace the command.
    """
    release = str(config.get("release") or "")
    if not config.get("id") or not RELEASE.match(release):
        raise TypeError("an Overture source needs id and a pinned release such as 2026-01-01.0")
    most = min(500 << 20, max(1024, int(config.get("maxDownloadBytes") or config.get("maxFileBytes") or 500 << 20)))

    def download(cfg: dict, bounds, target: str, timeout: float) -> None:
        command = [str(cfg.get("command") or "uvx"), *(cfg.get("commandArgs") or ["overturemaps"]), "download", f"--bbox={','.join(map(str, bounds))}", "-f", "geojson", "--type=building", "-r", release, "-o", target]
        subprocess.run(command, check=True, timeout=timeout, capture_output=True)  # noqa: S603

    def read(spark: SparkSession, request: Request, limits: Limits) -> Batch:
        if config.get("path"):
            df = spark.read.text(config["path"]).select(F.rtrim(F.trim("value"), F.lit(",")).alias("item")).filter(F.col("item").startswith('{"type"') & F.col("item").contains('"Feature"') & ~F.col("item").contains('"FeatureCollection"'))
            raw = features(df, config.get("includeSourceAliases", True))
            return Batch(raw.filter(geometry.in_bounds(geometry.parse(F.col("geometry")), request.bounds)) if request.bounds else raw, "", request.bounds)
        with tempfile.TemporaryDirectory() as folder:
            target = Path(folder, "buildings.geojson")
            (config.get("download") or download)(config, request.bounds, str(target), float(config.get("downloadTimeoutMs") or config.get("timeoutMs") or 120_000) / 1000)
            if target.stat().st_size > most:
                raise ValueError("the download exceeds maxDownloadBytes")
            body = target.read_text()
        doc = spark.createDataFrame([(body,)], "value string")
        items = doc.select(F.explode(F.from_json("value", "features array<string>")["features"]).alias("item"))
        return Batch(features(items, config.get("includeSourceAliases", True)), "", request.bounds, "", "", [], {"request_count": 1, "transferred_bytes": len(body), "from_cache": False})

    fixed = {**config, "datasetVersion": release, "capabilities": ["building"]}
    return define(fixed, read, dataset_id="overture-buildings", operator="Overture Maps Foundation", license_id="ODbL-1.0", attribution="Overture Maps Foundation", source_crs="OGC:CRS84")
