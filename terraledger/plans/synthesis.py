"""The main path: sources to a snapshot."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraledger.operators import entities as E
from terraledger.operators import relationships, summary
from terraledger.operators.matching import reconcile_providers
from terraledger.operators.normalize import normalize
from terraledger.session import reachable, written
from terraledger.sources.base import Source, classify, safe_message
from terraledger.types import SOURCE_STATUSES, Limits, Request, SourceError, SynthesisError, validate_bounds

from .snapshot import Snapshot, meta

SUMMARY = "provider_id string, dataset_id string, operator string, license_id string, attribution string, homepage string, status string, record_count long, coverage array<double>, warnings array<string>, error struct<code:string,message:string>, metrics struct<duration_ms:double,request_count:long,transferred_bytes:long,from_cache:boolean>"
DECISIONS = "pair struct<l:string,r:string>, source_id string, entity_type string, decision string, matched_id string, related_ids array<string>, reason string, candidates array<struct<rank:int,id:string,stable:string,distance_m:double,iou:double,name_agreement:double,address_agreement:double,type_agreement:double,score:double>>"


def select_sources(sources: list[Source], wanted: tuple[str, ...], limits: Limits) -> list[Source]:
    """The sources that can give a wanted type; too many sources or none are errors."""
    if not sources:
        raise TypeError("a synthesis needs at least one source")
    if len(sources) > limits.max_sources:
        raise SynthesisError(f"{len(sources)} sources exceed the limit of {limits.max_sources}", "RESOURCE_LIMIT")
    chosen = [s for s in sources if not wanted or set(s.capabilities) & set(wanted)]
    if not chosen:
        raise SynthesisError("no source supports the requested types", "NO_CAPABLE_PROVIDER")
    return chosen


def query_source(spark: SparkSession, source: Source, request: Request, limits: Limits = Limits(), retrieved_at: str = "") -> tuple[DataFrame, dict]:
    """(records, summary row) of one source, its records written out, so that all of its errors come here.

    At most max_records are taken, by source id, and then the status is partial. A record that cannot
    be normalized, is of an undeclared type, or repeats an id fails the whole source.
    """
    began = time.time()
    try:
        batch = source.read(spark, request, limits)
        taken = batch.records.orderBy("source_id").limit(limits.max_records + 1)
        raw = written(taken, "raw")
    except Exception as e:  # noqa: BLE001
        status = classify(e)
        raise SourceError(source.id, status, f"source {source.id} {status.replace('_', ' ')}: {safe_message(e)}") from e
    over = raw.count() > limits.max_records
    raw = raw.orderBy("source_id").limit(limits.max_records) if over else raw
    try:
        m = {**source.meta(), "source_url": batch.source_url}
        records = written(normalize(raw, m, limits, batch.retrieved_at or retrieved_at), "records")
        odd = records.filter(~F.col("entity_type").isin(*source.capabilities)).select("source_id", "entity_type").first()
        if odd:
            raise TypeError(f"record {odd[0]} has undeclared capability {odd[1]}")
        if records.groupBy("id").count().filter("count > 1").first():
            raise TypeError("duplicate source ids")
    except Exception as e:  # noqa: BLE001
        raise SourceError(source.id, "invalid_response", f"source {source.id} returned an invalid source record: {safe_message(e)}") from e
    if request.entity_types:
        records = records.filter(F.col("entity_type").isin(*request.entity_types))
    n = records.count()
    status = "partial" if over else batch.status if batch.status in SOURCE_STATUSES else "available" if n else "authoritative-empty"
    notes = sorted({*batch.warnings, *([f"record-limit-exceeded:{limits.max_records}"] if over else [])})
    return records, _row(source, status, n, batch.coverage or request.bounds, notes, None, {"duration_ms": 1000 * (time.time() - began), "request_count": 1, "transferred_bytes": 0, "from_cache": False, **batch.metrics})


def _row(source: Source, status: str, n: int, coverage, warnings: list[str], error: dict | None, metrics: dict) -> dict:
    m = source.meta()
    keep = {c: m[c] for c in ("dataset_id", "operator", "license_id", "attribution", "homepage")}
    return {"provider_id": source.id, **keep, "status": status, "record_count": n, "coverage": list(coverage) if coverage else None, "warnings": warnings, "error": error, "metrics": metrics}


def failed(source: Source, error: Exception, duration_ms: float = 0.0) -> dict:
    """The summary row of a source that gave nothing."""
    status = classify(error)
    code = getattr(error, "code", None) or f"PROVIDER_{status.upper()}"
    return _row(source, status, 0, None, [], {"code": str(code), "message": safe_message(error)}, {"duration_ms": duration_ms, "request_count": 0, "transferred_bytes": 0, "from_cache": False})


def assemble(spark: SparkSession, records: DataFrame, summaries: list[dict], decisions: DataFrame | None = None, request: dict | None = None) -> Snapshot:
    """The snapshot of normalized records and decisions."""
    ents, claims, resolved = E.assemble(records, decisions)
    rels = written(relationships.derive(ents), "relationships")
    ents = written(relationships.attach(ents, rels), "entities-related")
    prov = written(summary.provenance_table(records), "provenance")
    tables = {
        "entities": ents,
        "source_records": records,
        "claims": claims,
        "provenance": prov,
        "relationships": rels,
        "resolution": resolved,
        "decisions": decisions if decisions is not None else spark.createDataFrame([], DECISIONS),
        "provider_summary": spark.createDataFrame(sorted(summaries, key=lambda r: r["provider_id"]), SUMMARY),
        "coverage": summary.coverage(ents, claims),
        "attributions": summary.attribution(prov),
    }
    totals = summary.totals(ents, claims, prov).first().asDict()
    totals["evidence_class_counts"] = {r[0]: r[1] for r in summary.evidence_classes(claims).collect()}  # a row a class
    return Snapshot(tables, meta(tables, request or {}, totals))


def synthesize(spark: SparkSession, options: dict) -> Snapshot:
    """A snapshot of the sources within bounds.

    options: bounds, providers (sources), requestedCapabilities, limits, reconciliation
    ({enabled, policies, maxReportedCandidates}), reconciliations (a DataFrame of further decisions),
    continueOnProviderError (true unless false), retrievedAt. Sources are read side by side; one that
    fails or takes longer than its time becomes a row in the summary.
    """
    reachable(spark)
    bounds = validate_bounds(options.get("bounds"))
    given = options.get("limits") or {}
    names = {"maxProviders": "max_sources", "maxRecordsPerProvider": "max_records", "maxCoordinatesPerGeometry": "max_coordinates", "maxPropertiesPerRecord": "max_properties", "maxPropertyBytesPerRecord": "max_property_bytes", "providerTimeoutMs": "timeout_ms"}
    limits = Limits.of({names.get(k, k): v for k, v in given.items()})
    wanted = tuple(sorted(set(options.get("requestedCapabilities") or ())))
    sources = select_sources(list(options.get("providers") or ()), wanted, limits)
    request = Request(bounds, wanted)
    stamp = str(options.get("retrievedAt") or "") or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    found, rows = [], []
    pool = ThreadPoolExecutor(max_workers=len(sources))
    try:
        jobs = [(s, time.time(), pool.submit(query_source, spark, s, request, limits, stamp)) for s in sources]
        for source, began, job in jobs:
            try:
                # The limit is for the source's answer; Spark's own work on it has a minute more. All count from their own start.
                left = began + limits.timeout_ms / 1000 + 60 - time.time()
                records, row = job.result(timeout=max(0.0, left) if limits.timeout_ms else None)
                found.append(records)
                rows.append(row)
            except Exception as e:  # noqa: BLE001
                error = SourceError(source.id, "timeout", f"source {source.id} timeout after {limits.timeout_ms} ms") if isinstance(e, Late) and not isinstance(e, SourceError) else e
                if options.get("continueOnProviderError") is False:
                    raise error from e
                rows.append(failed(source, error, 1000 * (time.time() - began)))
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    if found:
        records = found[0]
        for more in found[1:]:
            records = records.unionByName(more)
    else:
        empty = spark.createDataFrame([], _raw_schema())
        records = normalize(empty, sources[0].meta() | {"source_url": ""}, limits)
    records = written(records, "source-records")
    rule = options.get("reconciliation") or {}
    decisions = options.get("reconciliations")
    if rule.get("enabled") is True:
        made = reconcile_providers(records, sorted(r["provider_id"] for r in rows), rule.get("policies"), int(rule.get("maxReportedCandidates") or 5))
        made = written(made, "decisions")
        decisions = made if decisions is None else made.unionByName(decisions, allowMissingColumns=True)
    return assemble(spark, records, rows, decisions, {"bounds": list(bounds), "requested_capabilities": list(wanted), "limits": asdict(limits)})


def _raw_schema():
    from terraledger.types import RAW

    return RAW


__all__ = ["synthesize", "assemble", "query_source", "failed", "select_sources"]
