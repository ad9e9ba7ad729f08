import json

import pytest
from pyspark.sql import functions as F

from terraledger.operators import buildings, entities, matching, temporal
from terraledger.types import BuildingPolicy

COLUMNS = "id string, provider_id string, source_id string, entity_type string, geometry string, properties map<string,string>, aliases array<struct<namespace:string,id:string>>, gers_id string"


def point(x, y):
    return {"type": "Point", "coordinates": [x, y]}


def box(x0, y0, x1, y1):
    return {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}


def records(spark, *rows):
    out = []
    for r in rows:
        sid, kind, geo, props, *more = r
        aliases, gers, provider = (list(more) + [[], "", "p"][len(more) :])[:3]
        out.append((sid, provider, sid, kind, None if geo is None else json.dumps(geo), {k: json.dumps(v) for k, v in props.items()}, aliases, gers))
    return spark.createDataFrame(out, COLUMNS)


def decide(left, right, **kw):
    return {r.source_id: r for r in matching.reconcile(left, right, **kw).collect()}


PLACE = {"name": "Corner Café", "category": "shop"}


def test_each_type_matches(spark):
    road = {"type": "LineString", "coordinates": [[0.1, 0], [0.101, 0.001]]}
    left = records(spark, ("p", "poi", point(0, 0), PLACE), ("a", "address", point(1, 0), {"address": "1 High St"}), ("l", "parcel", box(2, 0, 2.001, 0.001), {}), ("r", "road", road, {"name": "Main", "class": "local"}), ("b", "building", box(3, 0, 3.001, 0.001), {"name": "Hall"}), ("w", "water", point(5, 5), {}))
    right = records(spark, ("p2", "poi", point(1e-5, 0), PLACE), ("a2", "address", point(1 + 1e-5, 0), {"address": "1 High St"}), ("l2", "parcel", box(2, 0, 2.001, 0.001), {}), ("r2", "road", road, {"name": "Main", "class": "local"}), ("b2", "building", box(3, 0, 3.001, 0.001), {"name": "Hall"}))
    got = decide(left, right)
    assert {k: (v.decision, v.matched_id) for k, v in got.items()} == {k: ("MATCH", k + "2") for k in "palrb"}
    assert got["p"].candidates[0].score >= 0.76 and got["p"].reason == "entity-policy-threshold"


def test_ambiguity_collision_and_limits(spark):
    twin = decide(records(spark, ("l", "poi", point(0, 0), PLACE)), records(spark, ("a", "poi", point(0, 0), PLACE), ("b", "poi", point(0, 0), PLACE)), reported=1)
    assert twin["l"].decision == "AMBIGUOUS" and twin["l"].reason == "multiple-similar-candidates" and len(twin["l"].candidates) == 1
    clash = decide(records(spark, ("x", "poi", point(0, 0), PLACE), ("y", "poi", point(0, 0), PLACE)), records(spark, ("r", "poi", point(0, 0), PLACE)))
    assert {(r.decision, r.reason, r.matched_id, tuple(r.related_ids)) for r in clash.values()} == {("AMBIGUOUS", "many-to-one-candidate-requires-review", None, ("r",))}
    far = decide(records(spark, ("l", "poi", point(0, 0), PLACE), ("n", "poi", None, PLACE)), records(spark, ("r", "poi", point(0.01, 0), PLACE)))
    assert {r.reason for r in far.values()} == {"no-spatial-candidate"}
    gate = decide(records(spark, ("l", "poi", point(0, 0), PLACE)), records(spark, ("r", "poi", point(0.0004, 0), PLACE)))
    assert gate["l"].reason in ("geometry-below-automatic-match-policy", "candidate-below-policy-threshold")
    odd = decide(records(spark, ("l", "building", point(0, 0), {})), records(spark, ("r", "building", box(-0.001, -0.001, 0.001, 0.001), {})))
    assert odd["l"].decision == "NO_MATCH" and odd["l"].candidates[0].score == 0


def test_stable_ids_come_first(spark):
    left = records(spark, ("l", "poi", point(0, 0), PLACE, [("osm", "n1")]))
    both = records(spark, ("near", "poi", point(0, 0), PLACE), ("far", "poi", point(50, 0), {}, [("osm", "n1")]))
    got = decide(left, both)["l"]
    assert (got.decision, got.matched_id, got.reason) == ("MATCH", "far", "shared-stable-identifier") and len(got.candidates) == 1
    two = decide(left, both.union(records(spark, ("far2", "poi", point(60, 0), {}, [("osm", "n1")]))))["l"]
    assert two.reason == "stable-identifier-maps-to-multiple-records"
    other = decide(left, records(spark, ("r", "building", None, {}, [("osm", "n1")])))["l"]
    assert other.decision == "NO_MATCH"


def test_large_and_small_boxes_meet(spark):
    left = records(spark, ("small", "parcel", box(0.5, 0.5, 0.5001, 0.5001), {}), ("huge", "parcel", box(-10, -10, 10, 10), {}))
    right = records(spark, ("wide", "parcel", box(-20, -1, 20, 1), {}), ("apart", "parcel", box(30, 30, 31, 31), {}))
    got = decide(left, right)
    assert [c.id for c in got["small"].candidates] == ["wide"] and [c.id for c in got["huge"].candidates] == ["wide"]


def test_policy_overrides(spark):
    left, right = records(spark, ("l", "poi", point(0, 0), PLACE)), records(spark, ("r", "poi", point(1e-5, 0), {"name": "Other", "category": "x"}))
    assert decide(left, right)["l"].decision == "NO_MATCH"
    assert decide(left, right, overrides={"poi": {"match_score": 0.2}})["l"].decision == "MATCH"


def test_designed_evaluation(spark):
    """200 left records of each of five types: 140 matches (20 by a shared id), 30 twins, 30 shifted and renamed."""
    left, right, truth = [], [], []
    shapes = {
        "poi": lambda x, y: point(x, y), "address": lambda x, y: point(x, y), "road": lambda x, y: {"type": "LineString", "coordinates": [[x, y], [x + 1e-3, y]]},
        "parcel": lambda x, y: box(x, y, x + 1e-3, y + 1e-3), "building": lambda x, y: box(x, y, x + 1e-3, y + 1e-3),
    }
    for t, (kind, shape) in enumerate(shapes.items()):
        for i in range(200):
            x, y, sid = 2.0 * t + (i % 20) * 0.01, (i // 20) * 0.01, f"{kind}-{i}"
            props = {"name": f"Place {sid}", "address": f"{i} {kind} street", "category": kind, "type": kind}
            alias = [("shared", sid)] if i < 20 else []
            left.append((sid, kind, shape(x, y), props, alias))
            if i < 140:
                right.append((sid + "r", kind, shape(x + 1e-5, y), props, alias))
                truth.append((sid, "MATCH", sid + "r"))
            elif i < 170:
                right += [(sid + c, kind, shape(x, y), props, []) for c in "ab"]
                truth.append((sid, "AMBIGUOUS", None))
            else:
                right.append((sid + "r", kind, shape(x + 2e-3, y), {"name": "Different", "address": "elsewhere 9", "category": "other", "type": "other"}, []))
                truth.append((sid, "NO_MATCH", None))
    a, b = records(spark, *left), records(spark, *right)
    d = matching.reconcile(a, b)
    m = matching.evaluate(d, spark.createDataFrame(truth, "source_id string, expected string, matched_id string")).first()
    assert tuple(m) == (1.0, 1.0, 1.0, 0, 1.0, 1.0)
    assert tuple(matching.counts(d).first()) == (700, 150, 150)


def test_grid_has_one_candidate_each(spark):
    import bench

    assert matching.metrics(*bench.grid(spark, 2500))["candidate_count"] == 2500


def test_building_matcher(spark):
    a = box(0, 0, 0.002, 0.001)
    left = records(spark, ("same", "building", a, {}), ("parts", "building", box(1, 0, 1.002, 0.001), {}), ("gers", "building", None, {}, [], "g1"), ("half", "building", box(2, 0, 2.002, 0.001), {}), ("none", "building", box(9, 9, 9.001, 9.001), {}))
    right = records(spark, ("r", "building", a, {}), ("p1", "building", box(1, 0, 1.0008, 0.001), {"buildingPart": "yes"}), ("g", "building", point(0, 0), {}, [], "g1"), ("h", "building", box(2, 0, 2.0012, 0.001), {}))
    got = {r.source_id: (r.decision, r.matched_id, tuple(r.related_ids)) for r in buildings.reconcile_buildings(left, right, BuildingPolicy()).collect()}
    assert got == {"same": ("MATCH", "r", ()), "parts": ("BUILDING_PART", None, ("p1",)), "gers": ("MATCH", "g", ()), "half": ("PROBABLE", None, ()), "none": ("NO_MATCH", None, ())}


def test_identity_is_transitive(spark):
    rows = records(spark, ("source:a:1", "poi", None, {}, [], "", "a"), ("source:b:1", "poi", None, {}, [], "", "b"), ("source:c:1", "poi", None, {}, [], "", "c"), ("source:d:1", "building", None, {}, [], "G", "d"), ("source:e:1", "poi", None, {}, [], "G", "e"))
    links = spark.createDataFrame([("source:a:1", "MATCH", "source:b:1"), ("source:b:1", "MATCH", "source:c:1"), ("source:c:1", "PROBABLE", "source:d:1"), ("source:a:1", "MATCH", "source:x:9")], "source_id string, decision string, matched_id string")
    groups = {}
    for r in entities.group_records(rows, links).collect():
        groups.setdefault(r.group_key, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [["source:a:1", "source:b:1", "source:c:1"], ["source:d:1", "source:e:1"]]
    ids = {r.id: (r.entity_id, r.identity_scope) for r in entities.members(entities.group_records(rows, links)).collect()}
    assert ids["source:d:1"] == ("tl:building:gers:G", "gers") and ids["source:a:1"][1] == "synthesis"


def test_temporal_statuses(spark):
    rows = [("a1", "A", 1.0, "f1", "2026-01-01", False, False), ("a2", "A", 2.0, "f2", "2026-01-02", False, False), ("b1", "", None, "f3", "2026-01-03", False, False)]
    df = lambda r: spark.createDataFrame(r, "id string, lineage_id string, revision double, fingerprint string, observed_at string, deleted boolean, possible_change boolean")
    status = lambda d, **k: {r.id: r.status for r in temporal.assess(d, **k).collect()}
    assert status(df(rows)) == {"a1": "SUPERSEDED", "a2": "UNRESOLVED_TEMPORAL_CONFLICT", "b1": "UNRESOLVED_TEMPORAL_CONFLICT"}
    assert status(df(rows[:2])) == {"a1": "SUPERSEDED", "a2": "CURRENT"}
    assert status(df(rows[:1]), now="2026-03-01", stale_after_ms=86_400_000) == {"a1": "STALE"}
    assert status(df([("a", "A", 1.0, "f", "", True, False), ("b", "B", 1.0, "f", "", False, True)])) == {"a": "DELETED_SOURCE_RECORD", "b": "POSSIBLE_CHANGE"}


def test_temporal_counts_equal_pairwise_comparison(spark):
    import random

    rng = random.Random(8)
    rows = [(f"o{i}", rng.choice(["", "L1", "L2", "L3"]), float(rng.randint(0, 2)), rng.choice([None, "", "f1", "f2"]), rng.random() < 0.2, rng.choice(["v", "w", None]), s) for s in range(60) for i in range(s * 10, s * 10 + rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "id string, lineage_id string, revision double, fingerprint string, deleted boolean, value string, s int")
    got = {r.id: r.status for r in temporal.assess(df, now="2026-01-01", subject="s").collect()}
    for s in range(60):
        own = [r for r in rows if r[6] == s]
        status = {r[0]: "CURRENT" for r in own}
        for line in {r[1] for r in own if r[1]}:
            ordered = sorted((r for r in own if r[1] == line), key=lambda r: (r[2], r[0]))
            for r in ordered[:-1]:
                status[r[0]] = "SUPERSEDED"
            status[ordered[-1][0]] = "DELETED_SOURCE_RECORD" if ordered[-1][4] else "CURRENT"
        active = [r for r in own if status[r[0]] == "CURRENT"]
        for a in active:
            for b in active:
                if a[0] < b[0] and not (a[1] and a[1] == b[1]):
                    differ = a[4] != b[4] or (a[3] != b[3] if a[3] and b[3] else a[5] != b[5])
                    if differ:
                        status[a[0]] = status[b[0]] = "UNRESOLVED_TEMPORAL_CONFLICT"
        assert {k: got[k] for k in status} == status


@pytest.mark.parametrize("tier,want", [(2, "curated"), (1, "none")])
def test_representation(spark, tier, want):
    rows = [("e", "o", "e", "observed", False, True, 0, None, True), ("e", "c", "e", "curated", None, None, 2, None, None), ("e", "x", "other", "observed", True, True, 0, None, True), ("e", "f", "e", "procedural", True, True, 0, 5.0, True)]
    df = spark.createDataFrame(rows, "wanted_id string, id string, entity_id string, class string, authorized boolean, license_permits_use boolean, minimum_device_tier int, max_distance_m double, available boolean")
    assert temporal.select_representation(df, device_tier=tier, distance_m=10).first().selected_class == want
    why = {r.id: r.rejection_reasons for r in temporal.representations(df, tier, 10).collect()}
    assert why["o"] == ["not-authorized"] and why["x"] == ["different-entity"] and why["f"] == ["outside-lod-distance"]


def test_a_continent_sized_box_does_not_pair_all_others(spark):
    """Rows that the join gives before boxes are compared grow with the rows, one huge box on either side or not; pairs are exact."""
    from terraledger.operators.blocking import box_pairs, in_one_cell

    def side(n, step, large):
        df = spark.range(n).select(F.lit(1).alias("k"), F.struct("id").alias("row"), (F.col("id") % 50 * 0.01 + step).alias("x"), (F.floor(F.col("id") / 50) * 0.01).alias("y"))
        df = df.select("k", "row", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 0.002).alias("x1"), (F.col("y") + 0.002).alias("y1")).alias("box"))
        huge = spark.range(large).select(F.lit(1).alias("k"), F.struct((F.col("id") + 1_000_000).alias("id")).alias("row"), F.struct(*[F.lit(v).alias(c) for c, v in (("x0", -30.0), ("y0", -30.0), ("x1", 30.0), ("y1", 30.0))]).alias("box"))
        return df.union(huge)

    for n in (500, 2000):
        got = box_pairs(side(n, 0.0, 1), side(n, 0.001, 1), ["k"])
        assert got.count() == n + 2 * n + 1 == got.select("l.id", "r.id").distinct().count()
    evaluated = {n: in_one_cell(side(n, 0.0, 1), side(n, 0.001, 1), ["k"]).count() for n in (500, 2000)}
    assert evaluated[2000] <= 6 * evaluated[500] and evaluated[2000] <= 30 * 2000


def test_revisions_may_be_texts(spark):
    rows = [("a", "L", "1"), ("b", "L", "v2"), ("c", "L", ""), ("d", "L", "10"), ("e", "", None), ("f", None, "x")]
    got = {r.id: r.status for r in temporal.assess(spark.createDataFrame(rows, "id string, lineage_id string, revision string")).select("id", "status").collect()}
    assert [k for k in "abcd" if got[k] != "SUPERSEDED"] == ["d"] and got["e"] != "SUPERSEDED" != got["f"]
