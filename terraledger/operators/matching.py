"""Scores of candidate pairs, the decision for every left record, and the collision check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraledger.functions import geometry, overlap, text
from terraledger.session import written
from terraledger.types import DECISIONS, RECONCILABLE_TYPES, Policy, policies

from .blocking import candidates, prepared, radius

# Weights of the signals by type.
PARCEL = (("iou", 0.85), ("name", 0.10), ("type", 0.05))
ADDRESS = (("address", 0.65), ("near", 0.35))
ROAD = (("ends", 0.45), ("name", 0.40), ("type", 0.15))
POI = (("name", 0.40), ("near", 0.35), ("type", 0.15), ("address", 0.10))


def agreement(group: str) -> Column:
    """Shared words of the first property of the group that both sides have."""
    a, b = F.col(f"l.{group}"), F.col(f"r.{group}")
    both = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda z: z["x"].isNotNull() & z["y"].isNotNull())
    first = F.get(both, 0)
    return text.jaccard(first["x"], first["y"])


def weighted(signals: list[tuple[Column, float]]) -> Column:
    """Mean of the signals that there are, by weight, within 0 and 1; 0 without any."""
    known = [(v.isNotNull() & ~F.isnan(v), v, w) for v, w in signals]
    total = sum((F.when(k, v * w).otherwise(0.0) for k, v, w in known), F.lit(0.0))
    weight = sum((F.when(k, F.lit(w)).otherwise(0.0) for k, v, w in known), F.lit(0.0))
    return F.when(weight > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / weight))).otherwise(0.0)


def _same(c: str) -> Column:
    a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
    return F.when((a != "") & (b != ""), (a == b).cast("double"))


def _ends(reach: Column) -> Column:
    a, b = F.col("l.ends"), F.col("r.ends")
    d = lambda p, q: geometry.distance_m(a[f"x{p}"], a[f"y{p}"], b[f"x{q}"], b[f"y{q}"])
    off = F.least(d(0, 0) + d(1, 1), d(0, 1) + d(1, 0))
    return F.coalesce(F.greatest(F.lit(0.0), 1 - off / (reach * 2)), F.lit(0.0))


def building_score(iou: Column, distance: Column) -> dict[str, Column]:
    small, large = F.least("l.area", "r.area"), F.greatest("l.area", "r.area")
    ratio = F.when(large > 0, small / large).otherwise(0.0)
    signs = [_same(c) for c in ("b_name", "b_address", "b_type")]
    n = sum((s.isNotNull().cast("int") for s in signs), F.lit(0))
    mean = F.when(n > 0, sum((F.coalesce(s, F.lit(0.0)) for s in signs), F.lit(0.0)) / n)
    raw = iou * 0.65 + ratio * 0.15 + F.greatest(F.lit(0.0), 1 - distance / 30) * 0.1 + F.coalesce(mean, F.lit(0.5)) * 0.1
    return {"area_ratio": ratio, "semantic": mean, "score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))}


def features(pairs: DataFrame, rules: dict[str, Policy]) -> DataFrame:
    """pairs with distance_m, iou, name, address and type agreement, and score. Overlap is computed only for polygons without a shared id."""
    kind = F.col("l.entity_type")
    areal = geometry.is_areal(F.col("l.kind")) & geometry.is_areal(F.col("r.kind"))
    out = pairs.withColumn("iou", overlap.iou_column(F.when(areal, F.col("l.geometry")), F.when(areal, F.col("r.geometry"))))
    out = out.withColumn("distance_m", geometry.distance_m(F.col("l.c.x"), F.col("l.c.y"), F.col("r.c.x"), F.col("r.c.y")))
    out = out.withColumn("name_agreement", agreement("names")).withColumn("address_agreement", agreement("addresses")).withColumn("type_agreement", agreement("kinds"))
    reach = radius(kind, rules)
    signal = {
        "iou": F.col("iou"),
        "name": F.col("name_agreement"),
        "type": F.col("type_agreement"),
        "address": F.col("address_agreement"),
        "near": F.when(F.col("distance_m").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("distance_m") / reach)),
        "ends": _ends(reach),
    }
    of = lambda weights: weighted([(signal[s], w) for s, w in weights])
    building = F.when(areal, building_score(F.col("iou"), F.col("distance_m"))["score"]).otherwise(0.0)
    score = F.when(F.col("stable").isNotNull(), 1.0).when(kind == "building", building).when(kind == "parcel", of(PARCEL)).when(kind == "address", of(ADDRESS)).when(kind == "road", of(ROAD)).otherwise(of(POI))
    return out.withColumn("score", score)


def match_features(left: DataFrame, right: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Features of every candidate pair: left_id, right_id, stable_id, distance_m, iou, the agreements, score."""
    rules = policies(overrides)
    got = features(candidates(written(prepared(left), "left"), written(prepared(right), "right"), rules), rules)
    return got.select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), F.col("stable").alias("stable_id"), "distance_m", "iou", "name_agreement", "address_agreement", "type_agreement", "score")


def _policy(kind: Column, rules: dict[str, Policy], field: str) -> Column:
    out = F.when(F.lit(False), 0.0)
    for t, p in rules.items():
        v = getattr(p, field)
        out = out.when(kind == t, F.lit(None if v is None else float(v)).cast("double"))
    return out


def decide(scored: DataFrame, everyone: DataFrame, rules: dict[str, Policy], reported: int = 5) -> DataFrame:
    """One decision a (pair, left record). everyone: pair, source_id, entity_type of all left records."""
    keep = max(1, reported or 5)
    order = Window.partitionBy("pair", "source_id").orderBy(F.desc("score"), "right_id")
    ranked = scored.select("pair", F.col("l.id").alias("source_id"), F.col("r.id").alias("right_id"), "stable", "distance_m", "iou", "name_agreement", "address_agreement", "type_agreement", "score")
    top = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(2, keep))
    entry = F.struct("rank", F.col("right_id").alias("id"), "stable", "distance_m", "iou", "name_agreement", "address_agreement", "type_agreement", "score")
    lists = top.groupBy("pair", "source_id").agg(F.array_sort(F.collect_list(entry)).alias("top"))
    got = everyone.join(lists, ["pair", "source_id"], "left")
    best, second = F.get("top", 0), F.get("top", 1)
    need, delta = _policy(F.col("entity_type"), rules, "match_score"), _policy(F.col("entity_type"), rules, "ambiguity_delta")
    iou_floor, far = _policy(F.col("entity_type"), rules, "min_iou"), _policy(F.col("entity_type"), rules, "max_distance_m")
    areal = F.col("entity_type").isin("building", "parcel")
    gate = F.when(areal, best["iou"] >= iou_floor).otherwise(F.coalesce(best["distance_m"] <= far, F.lit(False)))
    close = F.coalesce((second["score"] >= need) & (best["score"] - second["score"] <= delta), F.lit(False))
    case = (
        F.when(F.col("top").isNull(), "no-spatial-candidate")
        .when(best["stable"].isNotNull() & second["stable"].isNotNull(), "stable-identifier-maps-to-multiple-records")
        .when(best["stable"].isNotNull(), "shared-stable-identifier")
        .when(best["score"] < need, "candidate-below-policy-threshold")
        .when(~gate, "geometry-below-automatic-match-policy")
        .when(close, "multiple-similar-candidates")
        .otherwise("entity-policy-threshold")
    )
    got = got.withColumn("reason", case).withColumn("best", best)
    kind = F.when(F.col("reason").isin("shared-stable-identifier", "entity-policy-threshold"), "MATCH").when(F.col("reason").isin("stable-identifier-maps-to-multiple-records", "multiple-similar-candidates"), "AMBIGUOUS").otherwise("NO_MATCH")
    got = got.withColumn("decision", kind)
    # Two left records on one right record, neither by a stable id: a person must decide.
    contested = got.filter("reason = 'entity-policy-threshold'").groupBy("pair", F.col("best.id").alias("target")).count().filter("count > 1").select("pair", "target", F.lit(True).alias("contested"))
    got = got.withColumn("target", F.when(F.col("reason") == "entity-policy-threshold", F.col("best.id"))).join(contested, ["pair", "target"], "left")
    clash = F.coalesce("contested", F.lit(False))
    return got.select(
        "pair",
        "source_id",
        "entity_type",
        F.when(clash, "AMBIGUOUS").otherwise(F.col("decision")).alias("decision"),
        F.when((F.col("decision") == "MATCH") & ~clash, F.col("best.id")).alias("matched_id"),
        F.when(clash, F.array("target")).otherwise(F.array().cast("array<string>")).alias("related_ids"),
        F.when(clash, "many-to-one-candidate-requires-review").otherwise(F.col("reason")).alias("reason"),
        F.coalesce(F.slice("top", 1, keep), F.array().cast("array<struct<rank:int,id:string,stable:string,distance_m:double,iou:double,name_agreement:double,address_agreement:double,type_agreement:double,score:double>>")).alias("candidates"),
    )


def reconcile(left: DataFrame, right: DataFrame, overrides: dict | None = None, reported: int = 5, ascii_only: bool = False) -> DataFrame:
    """Decisions for every left record of a reconcilable type against the right records."""
    rules = policies(overrides)
    a, b = written(prepared(left, ascii_only), "left"), written(prepared(right, ascii_only), "right")
    pair = F.struct(F.lit("left").alias("l"), F.lit("right").alias("r")).alias("pair")
    everyone = left.filter(F.col("entity_type").isin(*RECONCILABLE_TYPES)).select(pair, F.col("id").alias("source_id"), "entity_type")
    return decide(features(candidates(a, b, rules), rules), everyone, rules, reported)


def reconcile_providers(records: DataFrame, providers: list[str], overrides: dict | None = None, reported: int = 5) -> DataFrame:
    """Decisions between all pairs of providers in one job, each from the earlier to the later one by name."""
    rules = policies(overrides)
    p = written(prepared(records), "prepared")
    later = F.filter(F.array(*map(F.lit, sorted(providers))), lambda r: r > F.col("provider_id"))
    everyone = records.filter(F.col("entity_type").isin(*RECONCILABLE_TYPES)).select("provider_id", F.col("id").alias("source_id"), "entity_type", F.explode(later).alias("r"))
    everyone = everyone.select(F.struct(F.col("provider_id").alias("l"), "r").alias("pair"), "source_id", "entity_type")
    return decide(features(candidates(p, p, rules, ordered=True), rules), everyone, rules, reported)


def counts(decisions: DataFrame, values: tuple[str, ...] = DECISIONS) -> DataFrame:
    """One row: a count for each decision, zeros included."""
    return decisions.agg(*[F.count_if(F.col("decision") == v).alias(v) for v in values])


def metrics(left: DataFrame, right: DataFrame, overrides: dict | None = None) -> dict:
    """Left, right and candidate counts of a reconciliation."""
    rules = policies(overrides)
    return {"left_record_count": left.count(), "right_record_count": right.count(), "candidate_count": candidates(prepared(left), prepared(right), rules).count(), "index": "grid"}


def evaluate(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of precision, recall, f1, false_merges, ambiguity_retention, no_match_accuracy against truth (source_id, expected, matched_id)."""
    j = decisions.select("source_id", "decision", F.col("matched_id").alias("got")).join(truth, "source_id")
    made, right = F.col("decision") == "MATCH", (F.col("decision") == "MATCH") & (F.col("expected") == "MATCH") & (F.col("got") == F.col("matched_id"))
    s = j.agg(
        F.count_if(right).alias("hit"),
        F.count_if(made).alias("made"),
        F.count_if(F.col("expected") == "MATCH").alias("real"),
        F.count_if(made & ~F.coalesce(right, F.lit(False))).alias("false_merges"),
        F.count_if((F.col("expected") == "AMBIGUOUS") & (F.col("decision") == "AMBIGUOUS")).alias("held"),
        F.count_if(F.col("expected") == "AMBIGUOUS").alias("unclear"),
        F.count_if((F.col("expected") == "NO_MATCH") & (F.col("decision") == "NO_MATCH")).alias("apart"),
        F.count_if(F.col("expected") == "NO_MATCH").alias("alone"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    p, r = rate("hit", "made"), rate("hit", "real")
    return s.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1"), "false_merges", rate("held", "unclear").alias("ambiguity_retention"), rate("apart", "alone").alias("no_match_accuracy"))
