"""Caching of sources, and sources from a configuration file."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession

from terraledger.functions.text import canonical
from terraledger.types import Limits, Request

from .base import Batch, Source
from .feature_services import arcgis_source, geojson_source, ogc_source
from .local import file_source
from .openstreetmap import map_source, overpass_source
from .overture import overture_source

FACTORIES = {
    "arcgis-feature-service": arcgis_source,
    "geojson-http": geojson_source,
    "local-file": file_source,
    "ogc-api-features": ogc_source,
    "openstreetmap": overpass_source,
    "openstreetmap-map-api": map_source,
    "overture-maps": overture_source,
}


def cache_key(source: Source, request: Request) -> str:
    seed = canonical({"datasetVersion": source.dataset_version, "bounds": list(request.bounds or ()), "capabilities": list(request.entity_types)})
    return f"{source.id}:{hashlib.sha256(seed.encode()).hexdigest()}"


class ParquetCache:
    """Raw answers of sources as Parquet under a folder, with what is known about each in a row beside it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, key: str) -> str:
        return f"{self.path}/{re.sub(r'[^A-Za-z0-9._-]', '_', key)}"

    def get(self, key: str) -> dict | None:
        at = self._at(key)
        try:
            meta = json.loads(self.spark.read.text(f"{at}/meta").first()[0])
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return {"expires_at": meta.pop("expires_at"), "value": Batch(self.spark.read.parquet(f"{at}/records"), **meta)}

    def set(self, key: str, entry: dict) -> Batch:
        at, b = self._at(key), entry["value"]
        b.records.write.mode("overwrite").parquet(f"{at}/records")
        meta = {"expires_at": entry["expires_at"], "status": b.status, "coverage": b.coverage, "source_url": b.source_url, "retrieved_at": b.retrieved_at, "warnings": b.warnings, "metrics": b.metrics}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/meta")
        return replace(b, records=self.spark.read.parquet(f"{at}/records"))


def with_cache(source: Source, cache, ttl_ms: int | None = None, now=lambda: time.time() * 1000) -> Source:
    """The source, asked once for each version, bounds and types; a time to live of 0 never ends. Any get(key)/set(key, entry) will do as a cache."""
    if not callable(getattr(cache, "get", None)) or not callable(getattr(cache, "set", None)):
        raise TypeError("a cache needs get(key) and set(key, entry)")
    ttl = max(0, int(source.cache_ttl_ms if ttl_ms is None else ttl_ms))

    def read(spark: SparkSession, request: Request, limits: Limits) -> Batch:
        key = cache_key(source, request)
        hit = cache.get(key)
        if hit and (not hit["expires_at"] or hit["expires_at"] > now()):
            b = hit["value"]
            return replace(b, metrics={**b.metrics, "from_cache": True})
        b = source.read(spark, request, limits)
        return cache.set(key, {"expires_at": now() + ttl if ttl else 0, "value": b}) or b

    return replace(source, read=read)


def expanded(value):
    """value with ${NAME} in its texts replaced from the environment; a name that is not set raises."""
    if isinstance(value, list):
        return [expanded(v) for v in value]
    if isinstance(value, dict):
        return {k: expanded(v) for k, v in value.items()}
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise KeyError(f"the configuration needs environment variable {m[1]}")
        return os.environ[m[1]]

    return re.sub(r"\$\{([A-Z_][A-Z0-9_]*)\}", put, value)


def load_workflow(path: str) -> dict:
    """Options for synthesize() from a JSON file; paths of local files are relative to it."""
    at = Path(path).resolve()
    try:
        doc = json.loads(at.read_text())
    except json.JSONDecodeError as e:
        raise SyntaxError(f"invalid workflow JSON: {e}") from None
    doc = expanded(doc)
    if not isinstance(doc.get("providers"), list) or not doc["providers"]:
        raise TypeError("a workflow needs a list of providers")
    sources = []
    for i, entry in enumerate(doc["providers"]):
        config = dict(entry)
        make = FACTORIES.get(config.pop("type", None))
        if not make:
            raise TypeError(f"unknown provider type at providers[{i}]: {entry.get('type')}")
        if entry["type"] == "local-file" and "://" not in config["path"]:
            config["path"] = str((at.parent / config["path"]).resolve())
        sources.append(make(config))
    return {**doc, "providers": sources}
