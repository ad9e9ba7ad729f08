"""The building matcher: outlines and parts ranked apart, five decisions, and relations of groups."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraledger.functions import geometry, overlap
from terraledger.session import written
from terraledger.types import BuildingPolicy

from .blocking import box_pairs, prepared
from .matching import building_score


def building_features(pairs: DataFrame) -> DataFrame:
    """pairs (l, r) of prepared buildings with iou, distance_m, area_ratio, semantic and score."""
    out = pairs.withColumn("iou", overlap.iou_column(F.col("l.geometry"), F.col("r.geometry")))
    out = out.withColumn("distance_m", geometry.distance_m(F.col("l.c.x"), F.col("l.c.y"), F.col("r.c.x"), F.col("r.c.y")))
    return out.withColumns(building_score(F.col("iou"), F.col("distance_m")))


def reconcile_buildings(left: DataFrame, right: DataFrame, policy: BuildingPolicy = BuildingPolicy()) -> DataFrame:
    """A decision for every left building: source_id, decision, matched_id, related_ids, reason, candidates.

    One right building of the same GERS id decides at once. Else polygons whose centres lie within the
    radius are scored; outlines decide, and parts only where no outline is probable.
    """
    a, b = (written(prepared(d.filter("entity_type = 'building'")), "buildings") for d in (left, right))
    gers = a.filter("gers_id <> ''").select("id", "gers_id").join(b.filter("gers_id <> ''").select(F.col("id").alias("rid"), "gers_id"), "gers_id")
    exact = gers.groupBy("id").agg(F.count("*").alias("n"), F.min("rid").alias("rid")).filter("n = 1").select("id", "rid")
    row = lambda d: F.struct(*[F.col(c) for c in d.columns]).alias("row")
    # A centre within the radius lies in the centre's box grown by it.
    spot = F.struct(F.col("c.x").alias("x0"), F.col("c.y").alias("y0"), F.col("c.x").alias("x1"), F.col("c.y").alias("y1"))
    areal = geometry.is_areal(F.col("kind"))
    seekers = a.filter(areal).join(exact.select("id"), "id", "left_anti").select(a.columns)
    pairs = box_pairs(seekers.select(row(a), F.lit(1).alias("k"), geometry.expanded(spot, F.lit(float(policy.radius_m) * 1.001)).alias("box")), b.filter(areal).select(row(b), F.lit(1).alias("k"), spot.alias("box")), ["k"])
    near = geometry.distance_m(F.col("l.c.x"), F.col("l.c.y"), F.col("r.c.x"), F.col("r.c.y")) <= policy.radius_m
    scored = building_features(pairs.filter(near).select("l", "r"))
    flat = scored.select(F.col("l.id").alias("source_id"), F.col("r.id").alias("right_id"), F.col("r.is_part").alias("part"), "score", "iou", "distance_m", "area_ratio", "semantic")
    by_kind = Window.partitionBy("source_id", "part").orderBy(F.desc("score"), "right_id")
    by_all = Window.partitionBy("source_id").orderBy(F.desc("score"), "right_id")
    ranked = flat.withColumn("kind_rank", F.row_number().over(by_kind)).withColumn("rank", F.row_number().over(by_all)).filter("kind_rank <= 2 or rank <= 5")
    pick = lambda part, k, c: F.max(F.when((F.col("part") == part) & (F.col("kind_rank") == k), F.col(c)))
    entry = F.struct("rank", F.col("right_id").alias("id"), "iou", "distance_m", "area_ratio", "semantic", "score")
    best = ranked.groupBy("source_id").agg(
        pick(False, 1, "right_id").alias("best"), pick(False, 1, "score").alias("s1"), pick(False, 1, "iou").alias("iou1"), pick(False, 2, "score").alias("s2"),
        pick(True, 1, "right_id").alias("part_id"), pick(True, 1, "iou").alias("part_iou"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, entry))).alias("candidates"),
    )
    probable = F.coalesce(F.col("s1") >= policy.probable_score, F.lit(False))
    twin = F.coalesce((F.col("s2") >= policy.probable_score) & (F.col("s1") - F.col("s2") <= policy.ambiguity_delta), F.lit(False))
    sure = (F.col("s1") >= policy.match_score) & (F.col("iou1") >= policy.min_automatic_iou)
    got = a.select(F.col("id").alias("source_id")).join(exact.withColumnRenamed("id", "source_id"), "source_id", "left").join(best, "source_id", "left")
    decision = (
        F.when(F.col("rid").isNotNull(), "MATCH")
        .when(probable & twin, "AMBIGUOUS")
        .when(probable & sure, "MATCH")
        .when(probable, "PROBABLE")
        .when(F.coalesce(F.col("part_iou") >= policy.part_iou, F.lit(False)), "BUILDING_PART")
        .otherwise("NO_MATCH")
    )
    got = got.withColumn("decision", decision)
    reason = F.when(F.col("rid").isNotNull(), "shared-gers-id")
    for d, r in (("AMBIGUOUS", "multiple-similar-candidates"), ("MATCH", "validated-geometry-and-semantic-threshold"), ("PROBABLE", "supporting-evidence-below-auto-merge-threshold"), ("BUILDING_PART", "explicit-building-part-with-spatial-support")):
        reason = reason.when(F.col("decision") == d, r)
    return got.select(
        "source_id",
        "decision",
        F.when(F.col("decision") == "MATCH", F.coalesce("rid", "best")).alias("matched_id"),
        F.when(F.col("decision") == "BUILDING_PART", F.array("part_id")).otherwise(F.array().cast("array<string>")).alias("related_ids"),
        reason.otherwise("no-candidate-above-probable-threshold").alias("reason"),
        "candidates",
    )


def relate_groups(groups: DataFrame, policy: BuildingPolicy = BuildingPolicy()) -> DataFrame:
    """Cardinality of building groups: group_id, decision, reason, grouped_iou, left_ids, right_ids.

    groups: group_id and, for each side, an ARRAY<STRUCT id, geometry, is_part> (lefts, rights). The union
    of a side's polygons is compared with that of the other. Groups of one left and at most one right
    building have decision PAIRWISE here: reconcile_buildings() decides them.
    """

    @F.pandas_udf("double")
    def iou(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        def union(side) -> dict | None:
            polygons = []
            for g in side:
                g = json.loads(g) if g else {}
                polygons += [g["coordinates"]] if g.get("type") == "Polygon" else g["coordinates"] if g.get("type") == "MultiPolygon" else []
            return {"type": "MultiPolygon", "coordinates": polygons} if polygons else None

        out = []
        for a, b in zip(lefts, rights):
            a, b = union(a), union(b)
            out.append(overlap.safe_iou(json.dumps(a), json.dumps(b)) if a and b else 0.0)
        return pd.Series(out)

    g = groups.withColumn("grouped_iou", iou(F.col("lefts.geometry"), F.col("rights.geometry")))
    n, m = F.size("lefts"), F.size("rights")
    enough = F.col("grouped_iou") >= policy.cardinality_iou
    parts = (m > 0) & F.forall("rights", lambda r: r["is_part"]) & (F.col("grouped_iou") >= policy.part_iou)
    case = (
        F.when((n == 1) & (m <= 1), F.struct(F.lit("PAIRWISE").alias("d"), F.lit("one-to-one").alias("r")))
        .when(enough & (n > 1) & (m == 1), F.struct(F.lit("MANY_TO_ONE").alias("d"), F.lit("left-group-union-corresponds-to-right-outline").alias("r")))
        .when(parts, F.struct(F.lit("BUILDING_PART").alias("d"), F.lit("explicit-building-part-group-with-spatial-support").alias("r")))
        .when(enough & (n == 1) & (m > 1), F.struct(F.lit("ONE_TO_MANY").alias("d"), F.lit("right-group-union-corresponds-to-left-outline").alias("r")))
        .when(F.col("grouped_iou") > 0, F.struct(F.lit("AMBIGUOUS").alias("d"), F.lit("complex-overlap-below-cardinality-threshold").alias("r")))
        .otherwise(F.struct(F.lit("NO_MATCH").alias("d"), F.lit("no-group-overlap").alias("r")))
    )
    ids = lambda side: F.array_sort(F.transform(side, lambda x: x["id"]))
    return g.withColumn("_c", case).select("group_id", F.col("_c.d").alias("decision"), F.col("_c.r").alias("reason"), "grouped_iou", ids("lefts").alias("left_ids"), ids("rights").alias("right_ids"))
