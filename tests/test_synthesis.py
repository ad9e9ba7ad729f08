import json
import math
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terraledger import cli
from terraledger.plans import diff, exporters
from terraledger.plans.postgis import PostgisStore
from terraledger.plans.snapshot import Snapshot, SnapshotStore
from terraledger.plans.synthesis import synthesize
from terraledger.sources.base import Source
from terraledger.sources.local import local_source
from terraledger.types import RAW, SourceError, SynthesisError

#: An invented ferry landing: a depot on its plot, a path, one kiosk in the depot and one beside it, and a laser survey of the depot.
BOUNDS = [7.4120, 62.7310, 7.4260, 62.7390]
RING = [[7.4172, 62.7341], [7.4196, 62.7341], [7.4196, 62.7352], [7.4184, 62.7352], [7.4184, 62.7357], [7.4172, 62.7357], [7.4172, 62.7341]]
R = 6378137.0
PROJECTED = [[x * R * math.pi / 180, R * math.log(math.tan(math.pi / 4 + y * math.pi / 360))] for x, y in RING]


def record(source_id, kind, shape, coordinates, properties, **more):
    return {"sourceId": source_id, "entityType": kind, "geometry": {"type": shape, "coordinates": coordinates}, "properties": properties, "evidenceClass": "DIRECT_SOURCE", **more}


def sources(storeys=6):
    shared = {"licenseId": "ODbL-1.0", "operator": "survey office", "attribution": "survey office, invented"}
    plot = [[7.4160, 62.7335], [7.4210, 62.7338], [7.4208, 62.7362], [7.4158, 62.7360], [7.4160, 62.7335]]
    depot = {"name": "Ferry depot", "type": "transport", "roof": "gable", "storeys": 5}
    cadastre = [
        record("b/900", "building", "Polygon", [RING], depot, gersId="syn-depot", observedAt="2031-03-09T06:00:00Z"),
        record("p/31", "parcel", "Polygon", [plot], {"name": "Plot 31", "zoning": "port"}),
        record("w/5", "road", "LineString", [[7.4130, 62.7320], [7.4165, 62.7330], [7.4240, 62.7380]], {"name": "Quay path", "class": "footway"}),
        record("k/1", "poi", "Point", [7.4178, 62.7346], {"name": "Ticket hatch", "category": "tickets"}),
        record("k/2", "poi", "Point", [7.4230, 62.7375], {"name": "Bait stall", "category": "shop", "open": False}),
    ]
    laser = [record("scan-12", "building", "Polygon", [PROJECTED], {"name": "Ferry depot", "storeys": storeys, "height": 19.5}, gersId="syn-depot", observedAt="2031-05-20T12:30:00Z")]
    return [local_source({"id": "cadastre", "sourceCrs": "OGC:CRS84", "records": cadastre, **shared}), local_source({"id": "laser", "sourceCrs": "EPSG:3857", "records": laser, **shared})]


def options(providers, **more):
    return {"bounds": BOUNDS, "providers": providers, "requestedCapabilities": ["building", "parcel", "road", "poi"], "reconciliation": {"enabled": True}, **more}


@pytest.fixture(scope="module")
def snap(spark):
    return synthesize(spark, options(sources()))


@pytest.fixture(scope="module")
def changed(spark):
    return synthesize(spark, options(sources(7)))


def test_basic(snap):
    assert snap.entities.count() == 5 and snap.claims.count() == 16 and snap.meta["totals"]["unresolved_conflicts"] == 1
    b = snap.entities.filter("type = 'building'").first()
    assert b.id == "tl:building:gers:syn-depot" and b.resolved["storeys"] == "6" and [c.property for c in b.conflicts] == ["storeys"] and b.evidence_summary.source_count == 2
    rel = {(r.type, r.source_id.split(":")[1], r.target_id.split(":")[1]) for r in snap.relationships.collect()}
    assert rel == {("located_on_parcel", "building", "parcel"), ("located_in_building", "poi", "building")}
    assert {r.decision for r in snap.decisions.collect()} == {"MATCH", "NO_MATCH"}
    assert {r.activity.id if r.activity else None for r in snap.provenance.select("activity").collect()} == {None, "crs-transform:EPSG:3857:OGC:CRS84"}


def test_fingerprint_ignores_order_and_time(spark, snap, changed):
    again = synthesize(spark, options(sources()[::-1], retrievedAt="2030-01-01"))
    assert again.fingerprint == snap.fingerprint != changed.fingerprint


def test_diff_store_and_inspect(spark, snap, changed, tmp_path):
    d = diff.diff_document(diff.diff_snapshots(snap, changed))
    assert d["changed"] and d["affected_entity_ids"] == ["tl:building:gers:syn-depot"] and len(d["claims"]["added"]) == len(d["claims"]["removed"]) == 1
    assert not diff.diff_snapshots(snap, snap)["changed"] and diff.diff_snapshots(snap, snap)["affected_entities"].count() == 0
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.load() is None and store.list() == []
    store.save(snap)
    store.apply_incremental(snap, changed)
    assert store.load().fingerprint == changed.fingerprint and store.list() == sorted([snap.fingerprint, changed.fingerprint]) and len(store.history(0)) == 2
    assert store.load(snap.fingerprint).entities.count() == 5 and store.load("0" * 64) is None
    with pytest.raises(ValueError):
        store.load("../x")
    got = diff.inspect_entity(snap, "tl:building:gers:syn-depot")
    assert {k: v.count() for k, v in got.items()} == {"entity": 1, "source_records": 2, "claims": 7, "provenance": 2, "reconciliation": 1, "selections": 5, "temporal": 7, "conflicts": 2}
    assert diff.inspect_entity(snap, "nothing") is None


def test_exports(snap, tmp_path):
    g = exporters.to_geojson(snap)
    assert len(g["features"]) == 5 and g["tl:fingerprint"] == snap.fingerprint
    b = next(f for f in g["features"] if f["id"].startswith("tl:building"))
    assert b["properties"]["storeys"] == 6 and b["properties"]["_tl:unresolvedConflictCount"] == 1 and b["geometry"]["coordinates"] == [RING]
    p = exporters.to_prov_json(snap)
    assert len(p["entity"]) == 11 and len(p["agent"]) == 2 and len(p["wasDerivedFrom"]) == 6 and len(p["wasAttributedTo"]) == 6 and len(p["activity"]) == 1
    assert json.loads(exporters.to_canonical_json(snap, pretty=False))["fingerprint"] == snap.fingerprint
    exporters.write_geojson_lines(snap, f"file://{tmp_path}/lines")
    exporters.write_entities(snap, f"file://{tmp_path}/entities")
    assert snap.entities.sparkSession.read.parquet(f"file://{tmp_path}/entities").filter("bbox.x0 < 7.4175").count() == 3


def test_failures_become_rows(spark):
    def broken(spark, request, limits):
        raise RuntimeError("HTTP 429 https://u:p@h/?token=x")

    bad = Source("broken", broken, ("poi",))
    s = synthesize(spark, options([sources()[0], bad]))
    rows = {r.provider_id: r for r in s.provider_summary.collect()}
    assert rows["broken"].status == "rate_limited" and "token=REDACTED" in rows["broken"].error.message and "u:p" not in rows["broken"].error.message
    assert s.entities.count() == 5
    with pytest.raises(SourceError):
        synthesize(spark, options([bad], continueOnProviderError=False))
    with pytest.raises(SynthesisError) as e:
        synthesize(spark, options([bad], requestedCapabilities=["water"]))
    assert e.value.code == "NO_CAPABLE_PROVIDER"
    with pytest.raises(SynthesisError) as e:
        synthesize(spark, options([bad, bad], limits={"maxProviders": 1}))
    assert e.value.code == "RESOURCE_LIMIT"
    assert synthesize(spark, options([bad])).entities.count() == 0


def test_cli(spark, tmp_path, capsys):
    config = tmp_path / "w.json"
    places = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": f"p{i}", "geometry": {"type": "Point", "coordinates": [7.42 + i * 1e-3, 62.735]}, "properties": {"name": f"P{i}", "kind": "shop"}} for i in range(2)]}
    (tmp_path / "places.geojson").write_text(json.dumps(places))
    config.write_text(json.dumps({"bounds": BOUNDS, "requestedCapabilities": ["poi"], "providers": [{"type": "local-file", "id": "places", "path": "places.geojson", "entityType": "poi", "publicFields": ["name", "kind"], "fieldMap": {"kind": "category"}}]}))
    out = tmp_path / "out"
    assert cli.main(["synthesize", str(config), "--output", str(out)]) == 0
    assert "Wrote 2 entities and 4 claims" in capsys.readouterr().out
    world = json.loads((out / "world.json").read_text())
    assert len(world["source_records"]) == 2 and len(json.loads((out / "world.geojson").read_text())["features"]) == 2
    records = tmp_path / "r.json"
    records.write_text(json.dumps([{"id": r["id"], "entityType": r["entity_type"], "geometry": json.loads(r["geometry"]), "properties": {k: json.loads(v) for k, v in r["properties"].items()}} for r in world["source_records"]]))
    assert cli.main(["reconcile", str(records), str(records), "--output", str(tmp_path / "d.json")]) == 0
    assert [d["decision"] for d in json.loads((tmp_path / "d.json").read_text())["decisions"]] == ["MATCH", "MATCH"]
    at = str(out / "snapshot")
    assert cli.main(["diff", at, at, "--output", str(tmp_path / "diff.json")]) == 0 and json.loads((tmp_path / "diff.json").read_text())["changed"] is False
    for form in ("canonical", "geojson", "prov-json"):
        assert cli.main(["export", at, "--format", form, "--output", str(tmp_path / form)]) == 0
        json.loads((tmp_path / form).read_text())
    capsys.readouterr()
    assert cli.main(["inspect", at]) == 0 and '"entities": 2' in capsys.readouterr().out
    assert cli.main(["inspect", str(tmp_path / "nothing")]) == 1


class Client:
    """Records what it is asked; answers the snapshot query with what was stored."""

    def __init__(self, fail_on=""):
        self.calls, self.stored, self.fail_on = [], [], fail_on

    def execute(self, sql, params):
        self.calls.append((sql, params))
        if self.fail_on and self.fail_on in sql:
            raise RuntimeError("no")
        if "INSERT INTO" in sql and ".snapshots" in sql:
            self.stored.append((params[1], json.loads(params[2])))
        return self.stored[-1:] if sql.startswith("SELECT fingerprint, document") else []


def test_postgis(snap, changed):
    c = Client()
    store = PostgisStore(c)
    store.initialize()
    store.save(snap)
    assert store.load()["fingerprint"] == snap.fingerprint
    start = len(c.calls)
    got = store.apply_incremental(snap, changed)
    later = [s for s, _ in c.calls[start:]]
    assert got["diff"]["affected_entity_ids"] == ["tl:building:gers:syn-depot"] and later[0] == "BEGIN" and later[-1] == "COMMIT"
    assert sum("INSERT INTO terraledger.entities" in s for s in later) == 1 and any("ANY(%s)" in s for s in later)
    bad = Client("INSERT INTO terraledger.claims")
    with pytest.raises(RuntimeError):
        PostgisStore(bad).save(snap)
    assert bad.calls[-1][0] == "ROLLBACK"
    store.history(5000)
    assert c.calls[-1][1] == ("default", 1000)
    with pytest.raises(ValueError):
        PostgisStore(c, schema="x; drop")


def test_stream(spark, tmp_path):
    from terraledger.sources.base import frame
    from terraledger.streaming.incremental import Ledger

    source = {"id": "feed", "dataset_id": "feed", "dataset_version": "1", "operator": "", "license_id": "CC0-1.0", "attribution": "", "source_crs": "OGC:CRS84", "privacy": "public"}
    place = lambda i, name: {"sourceId": str(i), "entityType": "poi", "geometry": {"type": "Point", "coordinates": [i, 0]}, "properties": {"name": name}}
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", source)
    folder = str(tmp_path / "in")
    for batch in ([place(1, "a"), place(2, "b")], [place(2, "c"), place(3, "d"), {"sourceId": "", "entityType": "poi"}]):
        frame(spark, batch).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(RAW).parquet(folder)
        ledger.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    got = ledger.store.load()
    assert sorted(r.name for r in got.entities.select(F.col("resolved")["name"].alias("name")).collect()) == ['"a"', '"c"', '"d"'] and len(ledger.store.list()) == 2


def test_entry_without_the_corpus_subpackage(tmp_path):
    """The rest imports, and offers its queries, where the corpus folders are gone."""
    import shutil

    root = Path(__file__).resolve().parent.parent
    for name in ("terraledger", "__spark_entry__.py"):
        src = root / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not [n for n in q if n.startswith('op')] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def test_snapshot_reload(spark, snap, tmp_path):
    snap.save(f"file://{tmp_path}/s")
    assert Snapshot.load(spark, f"file://{tmp_path}/s").meta == snap.meta
