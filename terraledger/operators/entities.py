"""Identity groups, canonical entities, claims and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraledger.functions import text
from terraledger.session import written
from terraledger.types import EVIDENCE_CLASSES, NAMESPACE, SYNTHESIS_VERSION, TIMES

from .components import components
from .normalize import evidence_rank


def identity_key(gers: Column, provider: Column, source_id: Column) -> Column:
    return F.when(F.coalesce(gers, F.lit("")) != "", F.concat(F.lit("gers:"), gers)).otherwise(F.concat_ws(":", provider, source_id))


def group_records(records: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """records with group_key: the component of records that share an identity key or a MATCH whose ends both exist."""
    keyed = records.withColumn("_key", identity_key(F.col("gers_id"), F.col("provider_id"), F.col("source_id")))
    # Records of one key hang on the first of them: one edge a record.
    firsts = keyed.groupBy("_key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    edges = keyed.join(firsts, "_key").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    if decisions is not None:
        ids = records.select("id").distinct()
        made = decisions.filter("decision = 'MATCH' and matched_id is not null").select(F.col("source_id").alias("a"), F.col("matched_id").alias("b"))
        made = made.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
        edges = edges.unionByName(made)
    found = components(edges, "identity")
    return records.join(found, records["id"] == found["node"], "left").withColumn("group_key", F.coalesce("component", "id")).drop("node", "component")


def canonical_id(kind: Column, gers: Column, anchors: Column) -> tuple[Column, Column]:
    """(id, scope) of a group: by its least GERS id, else by a hash of its sorted provider:source list."""
    named = F.coalesce(gers, F.lit("")) != ""
    hashed = F.sha2(F.to_json(anchors), 256)
    ident = F.when(named, F.concat(F.lit(f"{NAMESPACE}:"), kind, F.lit(":gers:"), gers)).otherwise(F.concat(F.lit(f"{NAMESPACE}:"), kind, F.lit(":"), hashed))
    scope = F.when(named, "gers").when(F.size(anchors) == 1, "source").otherwise("synthesis")
    return ident, scope


def members(grouped: DataFrame) -> DataFrame:
    """Each record's entity: record columns with entity_id."""
    anchors = F.array_sort(F.collect_list(F.concat_ws(":", "provider_id", "source_id")))
    gers = F.min(F.nullif(F.coalesce("gers_id", F.lit("")), F.lit("")))
    ids = grouped.groupBy("group_key").agg(F.min_by("entity_type", "id").alias("kind"), gers.alias("gers"), anchors.alias("anchors"))
    ident, scope = canonical_id(F.col("kind"), F.col("gers"), F.col("anchors"))
    return grouped.join(ids.select("group_key", ident.alias("entity_id"), scope.alias("identity_scope"), F.col("kind").alias("group_type")), "group_key")


def claims(rows: DataFrame) -> DataFrame:
    """One claim for each property of each record of members()."""
    p = F.col("provenance")
    opened = rows.select("entity_id", "evidence_class", p["id"].alias("provenance_id"), *[p[t].alias(t) for t in TIMES], F.explode("properties").alias("property", "raw"))
    opened = opened.withColumn("value", text.canonical_json(F.col("raw")))
    return opened.select(
        claim_id(F.col("property"), F.col("value"), F.col("provenance_id"), F.col("evidence_class"), F.lit("")).alias("id"),
        "entity_id", "property", "value", text.value_type(F.col("value")).alias("value_type"), "evidence_class", "provenance_id", *TIMES,
        F.lit("accepted").alias("status"), F.lit("").alias("reason"), F.lit("").alias("method"),
    )


def claim_id(prop: Column, value: Column, provenance_id: Column, cls: Column, method: Column) -> Column:
    return F.concat(F.lit("claim:"), text.sha(prop, value, provenance_id, cls, method))


def claim_time(c: str = "") -> Column:
    """The text that claims of one class are ordered by: time of the source's update, else of validity, else of observation."""
    return F.coalesce(*[F.nullif(F.col(t), F.lit("")) for t in ("source_updated_at", "valid_at", "observed_at")], F.lit(""))


def resolve_claims(all_claims: DataFrame) -> DataFrame:
    """One row per (entity_id, property): selected claim, value, class, reason, alternatives in rank order, conflict claim ids (null without conflict).

    Strongest class first, then the latest time as text, then the claim id. Direct claims of more than
    one value are a conflict. Claims of a property are gathered per entity, so a group is as large as
    the number of sources that describe one thing.
    """
    order = Window.partitionBy("entity_id", "property").orderBy(evidence_rank(F.col("evidence_class")), F.desc(claim_time()), "id")
    ranked = all_claims.withColumn("rank", F.row_number().over(order))
    direct = F.col("evidence_class") == "DIRECT_SOURCE"
    got = ranked.groupBy("entity_id", "property").agg(
        F.min_by(F.struct("id", "value", "evidence_class"), "rank").alias("best"),
        F.count("*").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "id")))), lambda x: x["id"]).alias("alternative_claim_ids"),
        F.count_distinct(F.when(direct, F.col("value"))).alias("direct_values"),
        F.array_sort(F.collect_list(F.when(direct, F.col("id")))).alias("direct_ids"),
    )
    reason = F.when(F.col("n") == 1, "only-available-claim").otherwise("strongest-evidence-then-newest-explicit-source-time-then-stable-id")
    return got.select("entity_id", "property", F.col("best.id").alias("selected_claim_id"), F.col("best.value").alias("value"), F.col("best.evidence_class").alias("evidence_class"), reason.alias("reason"), "alternative_claim_ids", F.when(F.col("direct_values") > 1, F.col("direct_ids")).alias("conflict_claim_ids"))


def entities(rows: DataFrame, all_claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """Canonical entities of members(), without relationships."""
    provider = F.col("provider_id")
    own = F.array(F.struct(provider.alias("namespace"), F.col("source_id").alias("id"), provider.alias("provider_id")))
    named = F.when(F.coalesce("gers_id", F.lit("")) != "", F.array(F.struct(F.lit("overture-gers").alias("namespace"), F.col("gers_id").alias("id"), provider.alias("provider_id"))))
    more = F.transform("aliases", lambda a: F.struct(a["namespace"].alias("namespace"), a["id"].alias("id"), provider.alias("provider_id")))
    none = F.array().cast("array<struct<namespace:string,id:string,provider_id:string>>")
    with_aliases = rows.withColumn("_aliases", F.concat(own, F.coalesce(named, none), F.coalesce(more, none)))
    has = F.col("geometry").isNotNull()
    base = with_aliases.groupBy("entity_id").agg(
        F.min_by("entity_type", "id").alias("type"),
        F.min("identity_scope").alias("identity_scope"),
        F.array_sort(F.flatten(F.collect_list("_aliases"))).alias("aliases"),
        F.min_by("geometry", F.when(has, F.col("id"))).alias("geometry"),
        F.min(F.when(has, F.col("id"))).alias("geometry_source_id"),
        F.count("*").alias("source_count"),
        F.count_distinct("provider_id").alias("provider_count"),
        F.bool_and(F.col("provenance.license_id") != "unknown").alias("provenance_complete"),
    )
    base = base.withColumn("geometry", F.when(F.col("geometry_source_id").isNotNull(), F.col("geometry")))
    facts = all_claims.groupBy("entity_id").agg(F.array_sort(F.collect_list("id")).alias("claim_ids"), F.min(evidence_rank(F.col("evidence_class"))).alias("_rank"))
    values = resolved.groupBy("entity_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "value")))).alias("resolved"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", F.struct("selected_claim_id", "evidence_class", "reason", "alternative_claim_ids"))))).alias("resolution"),
        F.array_sort(F.collect_list(F.when(F.col("conflict_claim_ids").isNotNull(), F.struct("property", F.col("conflict_claim_ids").alias("claim_ids"))))).alias("conflicts"),
    )
    out = base.join(facts, "entity_id", "left").join(values, "entity_id", "left")
    strings = F.array().cast("array<string>")
    classes = F.array(*map(F.lit, EVIDENCE_CLASSES))
    return out.select(
        F.col("entity_id").alias("id"), "type", "identity_scope", "aliases", "geometry", "geometry_source_id",
        F.coalesce("claim_ids", strings).alias("claim_ids"),
        F.coalesce("resolved", F.create_map().cast("map<string,string>")).alias("resolved"),
        "resolution",
        F.coalesce("conflicts", F.array().cast("array<struct<property:string,claim_ids:array<string>>>")).alias("conflicts"),
        F.struct(F.lit(SYNTHESIS_VERSION).alias("revision")).alias("lifecycle"),
        F.struct("source_count", "provider_count", F.coalesce(F.get(classes, F.col("_rank")), F.lit("UNKNOWN")).alias("strongest_class"), "provenance_complete").alias("evidence_summary"),
    )


def assemble(records: DataFrame, decisions: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, claims, resolution) of records and decisions, each written to the shared folder."""
    rows = written(members(group_records(records, decisions)), "members")
    all_claims = written(claims(rows), "claims")
    resolved = written(resolve_claims(all_claims), "resolution")
    return written(entities(rows, all_claims, resolved), "entities"), all_claims, resolved
