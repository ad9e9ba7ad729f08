"""Coverage, attribution and provenance summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraledger.types import EVIDENCE_CLASSES

# Types that coverage reports, and the properties of its categories.
COVERED_TYPES = ("building", "road", "parcel", "water", "landuse", "poi", "terrain")
SEMANTIC, NAMING, VERTICAL = ("type", "category", "class"), ("name", "address"), ("height", "levels", "elevation")
CATEGORIES = ("geometry", "identity", "semantic", "naming", "vertical", "relationship")
REQUIRED_PROVENANCE = ("provider_id", "dataset_id", "source_record_id", "license_id", "source_crs", "output_crs")


def provenance_table(records: DataFrame) -> DataFrame:
    """One row per provenance id."""
    p = records.select("provenance.*")
    return p.groupBy("id").agg(F.max_by(F.struct(*[F.col(c) for c in p.columns if c != "id"]), F.struct("source_updated_at", "retrieved_at", "dataset_version", "source_url")).alias("p")).select("id", "p.*")


def attribution(provenance: DataFrame) -> DataFrame:
    """Per provider, dataset, licence and attribution: operator, distinct URLs, record count."""
    urls = F.array_sort(F.collect_set(F.nullif("source_url", F.lit(""))))
    return provenance.groupBy("provider_id", "dataset_id", "license_id", "attribution").agg(F.min_by("operator", "id").alias("operator"), urls.alias("source_urls"), F.count("*").alias("source_record_count"))


def coverage(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(type, category, covered, total, ratio), a row for every reported type and category."""
    facts = claims.groupBy(F.col("entity_id").alias("id")).agg(*[F.bool_or(F.col("property").isin(*p)).alias(n) for n, p in (("semantic", SEMANTIC), ("naming", NAMING), ("vertical", VERTICAL))])
    e = entities.join(facts, "id", "left")
    yes = {
        "geometry": F.col("geometry").isNotNull(),
        "identity": F.size("aliases") > 0,
        "semantic": F.coalesce("semantic", F.lit(False)),
        "naming": F.coalesce("naming", F.lit(False)),
        "vertical": F.coalesce("vertical", F.lit(False)),
        "relationship": F.size("relationships") > 0,
    }
    counted = e.groupBy("type").agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in yes.items()])
    types = e.sparkSession.createDataFrame([(t,) for t in COVERED_TYPES], "type string")
    full = F.broadcast(types).join(counted, "type", "left").fillna(0)
    long = full.select("type", "total", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("covered")) for c in CATEGORIES])).alias("x"))
    return long.select("type", "x.category", "x.covered", "total", F.when(F.col("total") > 0, F.col("covered") / F.col("total")).alias("ratio"))


def evidence_classes(claims: DataFrame) -> DataFrame:
    """(evidence_class, n), zeros kept."""
    counted = claims.groupBy("evidence_class").agg(F.count("*").alias("n"))
    every = claims.sparkSession.createDataFrame([(c,) for c in EVIDENCE_CLASSES], "evidence_class string")
    return F.broadcast(every).join(counted, "evidence_class", "left").fillna(0)


def totals(entities: DataFrame, claims: DataFrame, provenance: DataFrame) -> DataFrame:
    """One row: direct and synthetic claims, unresolved conflicts, completeness of provenance (null without any)."""
    direct = claims.agg(F.count_if(F.col("evidence_class") == "DIRECT_SOURCE").alias("direct_claims"), F.count_if(F.col("evidence_class") == "SYNTHETIC").alias("synthetic_claims"))
    conflicts = entities.agg(F.coalesce(F.sum(F.size("conflicts")), F.lit(0)).alias("unresolved_conflicts"))
    full = sum((F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0) for c in REQUIRED_PROVENANCE), F.lit(0))
    complete = provenance.agg((F.sum(full) / (F.count("*") * len(REQUIRED_PROVENANCE))).alias("provenance_completeness"))
    # Three rows of one fact each become one row.
    rows = direct.unionByName(conflicts, allowMissingColumns=True).unionByName(complete, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
