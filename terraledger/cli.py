"""Command line: synthesize, inspect, diff, reconcile, export."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import __version__


def _session() -> SparkSession:
    from .session import reachable

    spark = SparkSession.builder.appName("terraledger").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return reachable(spark)


def _put(value, path: str | None) -> None:
    text = value if isinstance(value, str) else json.dumps(value, indent=2, ensure_ascii=False)
    if not path:
        print(text)
        return
    target = Path(path).resolve()
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text.rstrip() + "\n")
    print(f"Wrote {target}")


def _records(spark: SparkSession, path: str):
    """Records of a JSON file as the matchers read them; an id that is missing is the source id."""
    from pyspark.sql import functions as F

    from .sources.base import frame

    doc = json.loads(Path(path).read_text())
    rows = doc.get("records", doc.get("sourceRecords", doc)) if isinstance(doc, dict) else doc
    named = [{**r, "sourceId": r.get("id") or r.get("sourceId"), "attribution": r.get("providerId") or ""} for r in rows]
    df = frame(spark, named)
    return df.select(F.col("source_id").alias("id"), F.col("attribution").alias("provider_id"), "source_id", "entity_type", "geometry", "properties", "aliases", F.coalesce("gers_id", F.lit("")).alias("gers_id"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terraledger")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="verb", required=True)
    a = sub.add_parser("synthesize", help="a snapshot of a workflow's sources")
    a.add_argument("config")
    a.add_argument("--output", default="output/cli")
    a = sub.add_parser("inspect", help="totals of a snapshot, or one entity in full")
    a.add_argument("snapshot")
    a.add_argument("--entity")
    a = sub.add_parser("diff", help="the difference of two snapshots")
    a.add_argument("before")
    a.add_argument("after")
    a.add_argument("--output")
    a = sub.add_parser("reconcile", help="decisions between two files of records")
    a.add_argument("left")
    a.add_argument("right")
    a.add_argument("--output")
    a = sub.add_parser("export", help="a snapshot in another form")
    a.add_argument("snapshot")
    a.add_argument("--format", required=True, choices=["canonical", "geojson", "geojson-lines", "flatgeobuf", "prov-json"])
    a.add_argument("--output", required=True)
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    from .plans import diff, exporters
    from .plans.snapshot import Snapshot
    from .plans.synthesis import synthesize
    from .sources.workflow import load_workflow

    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    if args.verb == "synthesize":
        s = synthesize(spark, load_workflow(args.config))
        s.save(f"{args.output}/snapshot")
        _put(exporters.to_canonical_json(s), f"{args.output}/world.json")
        _put(exporters.to_geojson(s), f"{args.output}/world.geojson")
        print(f"Wrote {s.entities.count()} entities and {s.claims.count()} claims to {args.output}")
        told = [(r.provider_id, r.status, r.error) for r in s.provider_summary.select("provider_id", "status", "error").collect()]  # a row a source
        failed = [(name, status, error.message) for name, status, error in told if error]
        for name, status, message in failed:
            print(f"source {name}: {status}: {message}", file=sys.stderr)
        if told and len(failed) == len(told):
            raise RuntimeError("no source gave an answer")
    elif args.verb == "inspect":
        s = Snapshot.load(spark, args.snapshot)
        if args.entity:
            got = diff.inspect_entity(s, args.entity)
            _put(None if got is None else {k: rows(v) for k, v in got.items()}, None)
        else:
            _put({"fingerprint": s.fingerprint, "entities": s.entities.count(), "source_records": s.source_records.count(), "claims": s.claims.count(), "conflicts": s.meta["totals"]["unresolved_conflicts"], "providers": rows(s.provider_summary)}, None)
    elif args.verb == "diff":
        _put(diff.diff_document(diff.diff_snapshots(Snapshot.load(spark, args.before), Snapshot.load(spark, args.after))), args.output)
    elif args.verb == "reconcile":
        from .operators.matching import reconcile

        _put({"decisions": rows(reconcile(_records(spark, args.left), _records(spark, args.right)).orderBy("source_id"))}, args.output)
    else:
        s = Snapshot.load(spark, args.snapshot)
        if args.format == "geojson-lines":
            exporters.write_geojson_lines(s, args.output)
            print(f"Wrote {args.output}")
        elif args.format == "flatgeobuf":
            from .plans import flatgeobuf

            flatgeobuf.write(s, args.output)
            print(f"Wrote {args.output}")
        else:
            _put({"canonical": exporters.to_canonical_json, "geojson": exporters.to_geojson, "prov-json": exporters.to_prov_json}[args.format](s), args.output)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        run(args, _session())
    except Exception as e:  # noqa: BLE001
        from .sources.base import safe_message

        print(safe_message(e), file=sys.stderr)
        return 1
    return 0
