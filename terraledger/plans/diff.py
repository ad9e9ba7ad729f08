"""Differences of snapshots, and one entity in full."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .snapshot import Snapshot, row_hash

COLLECTIONS = ("entities", "source_records", "claims", "provenance")


def collection_diff(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """(id, change): added, removed or changed, by one full outer join of ids and row hashes."""
    either = before if before is not None else after
    none = either.limit(0)
    side = lambda df, n: (none if df is None else df).groupBy("id").agg(F.max(row_hash(either)).alias(n))
    j = side(before, "b").join(side(after, "a"), "id", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return j.select("id", change.alias("change")).filter("change is not null")


def affected_entities(before: Snapshot | None, after: Snapshot, changes: dict[str, DataFrame]) -> DataFrame:
    """Ids of entities that changed, or whose claims or source records did, in either snapshot."""
    out = changes["entities"].select("id")
    for s in (x for x in (before, after) if x is not None):
        out = out.union(s.claims.join(changes["claims"].select("id"), "id", "left_semi").select(F.col("entity_id").alias("id")))
        named = s.entities.select("id", F.explode("aliases").alias("x")).select("id", F.concat(F.lit("source:"), F.col("x.provider_id"), F.lit(":"), F.col("x.id")).alias("sid"))
        out = out.union(named.join(changes["source_records"].select(F.col("id").alias("sid")), "sid", "left_semi").select("id"))
    return out.distinct()


def diff_snapshots(before: Snapshot | None, after: Snapshot) -> dict:
    """changed, both fingerprints, a DataFrame of changes for each collection, and affected_entities."""
    changes = {c: collection_diff(before.tables[c] if before else None, after.tables[c]) for c in COLLECTIONS}
    a = before.fingerprint if before else ""
    return {"schema_version": 1, "before_fingerprint": a, "after_fingerprint": after.fingerprint, "changed": a != after.fingerprint, **changes, "affected_entities": affected_entities(before, after, changes)}


def diff_document(d: dict) -> dict:
    """A difference as a JSON document with sorted ids."""
    out = {k: v for k, v in d.items() if not isinstance(v, DataFrame)}
    for c in COLLECTIONS:
        got = {r[0]: sorted(r[1]) for r in d[c].groupBy("change").agg(F.collect_list("id")).collect()}
        out[c] = {k: got.get(k, []) for k in ("added", "removed", "changed")}
    return {**out, "affected_entity_ids": sorted(r[0] for r in d["affected_entities"].collect())}


def inspect_entity(s: Snapshot, entity_id: str) -> dict[str, DataFrame] | None:
    """Everything about one entity: entity, source_records, claims, provenance, reconciliation, selections, temporal, conflicts. None if unknown."""
    entity = s.entities.filter(F.col("id") == entity_id)
    if not entity.first():
        return None
    claims = s.claims.filter(F.col("entity_id") == entity_id)
    aliases = entity.select(F.explode("aliases").alias("x")).select(F.col("x.provider_id").alias("provider_id"), F.col("x.id").alias("source_id")).distinct()
    records = s.source_records.join(F.broadcast(aliases), ["provider_id", "source_id"], "left_semi")
    ids = records.select(F.col("id").alias("rid"))
    roles = F.array_compact(F.concat(F.array("source_id", "matched_id"), "related_ids"))
    touched = s.decisions.withColumn("rid", F.explode(roles)).join(F.broadcast(ids), "rid", "left_semi").select("pair", "source_id").distinct()
    conflicts = entity.select(F.explode("conflicts").alias("x")).select("x.property", F.explode("x.claim_ids").alias("id")).join(claims, "id").drop(claims["property"])
    return {
        "entity": entity,
        "source_records": records,
        "claims": claims,
        "provenance": s.provenance.join(claims.select(F.col("provenance_id").alias("id")).distinct(), "id", "left_semi"),
        "reconciliation": s.decisions.join(F.broadcast(touched), ["pair", "source_id"], "left_semi"),
        "selections": s.resolution.filter(F.col("entity_id") == entity_id),
        "temporal": claims.select(F.col("id").alias("claim_id"), "status", "observed_at", "valid_at", "source_updated_at"),
        "conflicts": conflicts,
    }
