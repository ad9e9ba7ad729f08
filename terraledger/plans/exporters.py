"""Neutral exports: GeoJSON, PROV-JSON, canonical JSON, Parquet; lines in parallel, documents for snapshots that fit one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraledger.functions import geometry, text
from terraledger.types import NAMESPACE

from .snapshot import Snapshot


def geojson_features(entities: DataFrame) -> DataFrame:
    """(id, feature): a GeoJSON feature text for each entity with geometry."""
    q = lambda v: F.to_json(v)
    string = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)
    resolved = F.transform(F.map_entries("resolved"), lambda e: F.concat(string(e["key"]), F.lit(":"), e["value"]))
    own = {
        "entityType": string(F.col("type")),
        "identityScope": string(F.col("identity_scope")),
        "aliases": q(F.transform("aliases", lambda a: F.concat_ws(":", a["namespace"], a["id"]))),
        "claimIds": q(F.col("claim_ids")),
        "relationshipCount": F.size("relationships").cast("string"),
        "unresolvedConflictCount": F.size("conflicts").cast("string"),
        "evidenceSourceCount": F.col("evidence_summary.source_count").cast("string"),
    }
    fixed = F.array(*[F.concat(F.lit(f'"_{NAMESPACE}:{k}":'), v) for k, v in own.items()])
    props = F.concat(F.lit("{"), F.array_join(F.concat(resolved, fixed), ","), F.lit("}"))
    return entities.filter("geometry is not null").select("id", F.concat(F.lit('{"type":"Feature","id":'), string(F.col("id")), F.lit(',"geometry":'), F.col("geometry"), F.lit(',"properties":'), props, F.lit("}")).alias("feature"))


def write_geojson_lines(s: Snapshot, path: str) -> None:
    """One feature a line, in parallel: the form for large snapshots."""
    geojson_features(s.entities).select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def to_geojson(s: Snapshot) -> dict:
    features = [json.loads(r[0]) for r in geojson_features(s.entities).orderBy("id").select("feature").toLocalIterator()]
    credits = [r.asDict(True) for r in s.attributions.orderBy("provider_id", "dataset_id").toLocalIterator()]
    return {"type": "FeatureCollection", "name": "terraledger output", "features": features, f"{NAMESPACE}:schemaVersion": s.meta["schema_version"], f"{NAMESPACE}:fingerprint": s.fingerprint, f"{NAMESPACE}:attributions": credits}


def prov_tables(s: Snapshot) -> dict[str, DataFrame]:
    """PROV entities, agents, derivations and attributions as (id, body) tables of JSON texts."""
    n = NAMESPACE
    key = lambda kind, c: F.concat(F.lit(f"{n}:{kind}_"), F.sha2(c, 256))
    body = lambda **f: F.to_json(F.create_map(*[x for k, v in f.items() for x in (F.lit(k.replace("__", ":")), v.cast("string"))]))
    lit = F.lit
    sources = s.source_records.select(key("source", F.col("id")).alias("id"), body(prov__label=F.col("source_id"), prov__type=lit(f"{n}:SourceRecord"), tl__providerId=F.col("provider_id"), tl__licenseId=F.col("provenance.license_id")).alias("body"))
    label = F.coalesce(text.plain(F.col("resolved")["name"]), F.col("id"))
    things = s.entities.select(key("canonical", F.col("id")).alias("id"), body(prov__label=label, prov__type=lit(f"{n}:CanonicalEntity"), tl__entityType=F.col("type"), tl__canonicalId=F.col("id")).alias("body"))
    agents = s.provider_summary.select(key("provider", F.col("provider_id")).alias("id"), body(prov__label=F.coalesce(F.nullif("operator", lit("")), "provider_id"), prov__type=lit("prov:Organization"), tl__providerId=F.col("provider_id")).alias("body"))
    links = s.entities.select(F.col("id").alias("eid"), F.explode("aliases").alias("x")).join(s.source_records.select(F.col("id").alias("rid"), "provider_id", "source_id"), (F.col("x.provider_id") == F.col("provider_id")) & (F.col("x.id") == F.col("source_id"))).select("eid", "rid", "provider_id").distinct()
    act = lit(f"{n}:synthesis_{s.fingerprint}")
    derived = links.select(F.concat(lit(f"{n}:derivation_"), text.sha(F.col("eid"), F.col("rid"))).alias("id"), body(prov__generatedEntity=key("canonical", F.col("eid")), prov__usedEntity=key("source", F.col("rid")), prov__activity=act).alias("body"))
    credited = links.select(F.concat(lit(f"{n}:attribution_"), text.sha(F.col("rid"), F.col("provider_id"))).alias("id"), body(prov__entity=key("source", F.col("rid")), prov__agent=key("provider", F.col("provider_id"))).alias("body")).distinct()
    return {"entity": sources.unionByName(things), "agent": agents, "wasDerivedFrom": derived, "wasAttributedTo": credited}


def to_prov_json(s: Snapshot) -> dict:
    doc = {k: {r[0]: json.loads(r[1]) for r in t.toLocalIterator()} for k, t in prov_tables(s).items()}
    act = f"{NAMESPACE}:synthesis_{s.fingerprint}"
    return {"prefix": {"prov": "http://www.w3.org/ns/prov#", NAMESPACE: f"urn:{NAMESPACE}:"}, **doc, "activity": {act: {"prov:label": "terraledger", "prov:type": f"{NAMESPACE}:Synthesis"}}}


def to_document(s: Snapshot) -> dict:
    """All tables as one JSON document, rows in order of their ids."""
    order = {"decisions": ["pair", "source_id"], "resolution": ["entity_id", "property"], "provider_summary": ["provider_id"], "coverage": ["type", "category"], "attributions": ["provider_id", "dataset_id"]}
    return {**s.meta, **{t: [json.loads(r[0]) for r in df.orderBy(*order.get(t, ["id"])).select(F.to_json(F.struct(*df.columns))).toLocalIterator()] for t, df in s.tables.items()}}


def to_canonical_json(s: Snapshot, pretty: bool = True) -> str:
    doc = to_document(s)
    return json.dumps(doc, indent=2, ensure_ascii=False) if pretty else text.canonical(doc)


def write_entities(s: Snapshot, path: str) -> None:
    """Entities with geometry as Parquet: GeoJSON text, and a box struct that scans prune by."""
    b = geometry.bbox(geometry.parse(F.col("geometry")))
    s.entities.filter("geometry is not null").withColumn("bbox", b).write.mode("overwrite").parquet(path)
