"""Containment: the smallest parcel under a building, the smallest building around a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraledger.functions import geometry, text

from .blocking import box_pairs

# Fixed values: (inner type, outer type, relation, method).
RULES = (
    ("building", "parcel", "located_on_parcel", "centroid-in-smallest-containing-polygon"),
    ("poi", "building", "located_in_building", "point-in-smallest-containing-polygon"),
)


def contained(points: DataFrame, polygons: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(inner, outer) ids: for each point (id, x, y) the polygon (id, geometry) of least area, then least id, that has it."""
    keys = keys or []
    spot = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    a = points.filter("x is not null").select(*keys, F.lit(1).alias("k"), F.struct("id", "x", "y").alias("row"), spot.alias("box"))
    g = geometry.parse(F.col("geometry"))
    b = polygons.withColumn("_g", g).filter(F.col("_g.type") == "Polygon").withColumn("box", geometry.bbox(F.col("_g")))
    b = b.select(*keys, F.lit(1).alias("k"), F.struct("id", F.col("_g").alias("g"), geometry.area(F.col("_g")).alias("area")).alias("row"), "box")
    pairs = box_pairs(a, b, [*keys, "k"]).filter(geometry.polygon_contains(F.col("r.g"), F.col("l.x"), F.col("l.y")))
    # The least (area, id) is kept within each task before rows shuffle.
    return pairs.groupBy(F.col("l.id").alias("inner")).agg(F.min_by(F.col("r.id"), F.struct("r.area", "r.id")).alias("outer"))


def derive(entities: DataFrame) -> DataFrame:
    """Relationships: id, source_id, type, target_id, evidence_class, method, version."""
    g = geometry.parse(F.col("geometry"))
    box = entities.filter("geometry is not null").select("id", "type", "geometry", geometry.bbox(g).alias("b"))
    out = None
    for inner, outer, relation, method in RULES:
        points = box.filter(F.col("type") == inner).select("id", geometry.center(F.col("b"))["x"].alias("x"), geometry.center(F.col("b"))["y"].alias("y"))
        found = contained(points, box.filter(F.col("type") == outer).select("id", "geometry"))
        rel = found.select(F.col("inner").alias("source_id"), F.lit(relation).alias("type"), F.col("outer").alias("target_id"), F.lit("DERIVED_HIGH_CONFIDENCE").alias("evidence_class"), F.lit(method).alias("method"), F.lit(1).alias("version"))
        rel = rel.select(F.concat(F.lit("relationship:"), text.sha(F.col("source_id"), F.col("type"), F.col("target_id"), F.col("method"))).alias("id"), *rel.columns)
        out = rel if out is None else out.unionByName(rel)
    return out


def attach(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """entities with their relationships nested."""
    kind = "array<struct<id:string,type:string,target_id:string,evidence_class:string,method:string,version:int>>"
    nested = relationships.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("id", "type", "target_id", "evidence_class", "method", "version"))).alias("relationships"))
    out = entities.join(nested, entities["id"] == nested["source_id"], "left").drop("source_id")
    return out.withColumn("relationships", F.coalesce("relationships", F.array().cast(kind)))
