"""Schemas, enumerations and policies."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# The vocabularies of the data model, in their order of strength where they have one.
ENTITY_TYPES = ("building", "road", "parcel", "water", "landuse", "poi", "address", "terrain")
RECONCILABLE_TYPES = ("building", "poi", "address", "parcel", "road")
SOURCE_STATUSES = ("available", "authoritative-empty", "partial", "rate_limited", "timeout", "unavailable", "invalid_response")
EVIDENCE_CLASSES = ("DIRECT_SOURCE", "MULTI_SOURCE_SUPPORTED", "DERIVED_HIGH_CONFIDENCE", "INFERRED", "LOW_CONFIDENCE", "SYNTHETIC", "UNKNOWN")
TEMPORAL_STATUSES = ("CURRENT", "STALE", "SUPERSEDED", "POSSIBLE_CHANGE", "DELETED_SOURCE_RECORD", "UNRESOLVED_TEMPORAL_CONFLICT")
REPRESENTATION_CLASSES = ("observed", "curated", "procedural", "synthetic", "none")
IDENTITY_SCOPES = ("gers", "source", "synthesis")
DECISIONS = ("MATCH", "AMBIGUOUS", "NO_MATCH")
BUILDING_DECISIONS = ("MATCH", "PROBABLE", "AMBIGUOUS", "NO_MATCH", "BUILDING_PART")
SCHEMA_VERSION = SYNTHESIS_VERSION = 1
ENTITY_MATCHER_VERSION, BUILDING_MATCHER_VERSION = 3, 2
#: Prefix of canonical ids.
NAMESPACE = "tl"


@dataclass(frozen=True)
class Policy:
    """When records of one type may match: search radius, score, ambiguity margin, and a gate by overlap or distance."""

    radius_m: float
    match_score: float
    ambiguity_delta: float
    min_iou: float | None = None
    max_distance_m: float | None = None


# The default match policies.
POLICIES = {
    "building": Policy(80, 0.70, 0.06, min_iou=0.65),
    "poi": Policy(60, 0.76, 0.07, max_distance_m=35),
    "address": Policy(40, 0.82, 0.06, max_distance_m=25),
    "parcel": Policy(100, 0.78, 0.05, min_iou=0.72),
    "road": Policy(140, 0.78, 0.06, max_distance_m=70),
}


def policies(overrides: dict[str, dict] | None = None) -> dict[str, Policy]:
    return {t: replace(p, **(overrides or {}).get(t, {})) for t, p in POLICIES.items()}


@dataclass(frozen=True)
class BuildingPolicy:
    match_score: float = 0.70
    probable_score: float = 0.50
    ambiguity_delta: float = 0.06
    radius_m: float = 80
    min_automatic_iou: float = 0.65
    cardinality_iou: float = 0.55
    part_iou: float = 0.20


def _or_default(value, default):
    """A missing value or a zero is the default."""
    return value or default


@dataclass(frozen=True)
class Limits:
    max_sources: int = 8
    max_records: int = 5000
    max_coordinates: int = 100_000
    max_properties: int = 256
    max_property_bytes: int = 100_000
    timeout_ms: int = 15_000

    @staticmethod
    def of(values: dict | None) -> Limits:
        """Limits from a request: zero or nothing means the default, and each has its floor."""
        d, v = Limits(), values or {}
        floor = {"max_property_bytes": 1024, "timeout_ms": 0}
        return Limits(**{k: max(floor.get(k, 1), int(_or_default(v.get(k), getattr(d, k)))) for k in d.__dataclass_fields__})


ALIAS = T.StructType([T.StructField("namespace", T.StringType()), T.StructField("id", T.StringType())])
ACTIVITY = T.StructType([T.StructField("id", T.StringType()), T.StructField("method", T.StringType()), T.StructField("version", T.StringType()), T.StructField("input_ids", T.ArrayType(T.StringType()))])
TIMES = ("retrieved_at", "observed_at", "valid_at", "valid_from", "valid_to", "source_updated_at")

#: A record as a source gives it: geometry is GeoJSON text, property values are JSON texts, times are opaque texts.
RAW = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("source_crs", T.StringType()),
        T.StructField("geometry", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("aliases", T.ArrayType(ALIAS)),
        *[T.StructField(c, T.StringType()) for c in ("gers_id", "dataset_version", "source_url", "license_id", "attribution", "privacy", "evidence_class", *TIMES)],
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("activity", ACTIVITY),
    ]
)

#: What the matchers read of a record.
MATCHABLE = ("id", "provider_id", "entity_type", "geometry", "properties", "aliases", "gers_id")


class SynthesisError(Exception):
    """An error with a code and details."""

    def __init__(self, message: str, code: str = "SYNTHESIS_ERROR", details: dict | None = None) -> None:
        super().__init__(message)
        self.code, self.details = code, details

    def to_json(self) -> dict:
        return {"name": type(self).__name__, "code": self.code, "message": str(self), "details": self.details}


class SourceError(SynthesisError):
    """A source that failed, with the status that its row in the summary gets."""

    def __init__(self, source_id: str, status: str, message: str, details: dict | None = None) -> None:
        super().__init__(message, f"PROVIDER_{status.upper()}", {"provider_id": source_id, "status": status, **(details or {})})
        self.source_id, self.status = source_id, status


@dataclass(frozen=True)
class Request:
    bounds: tuple[float, float, float, float] | None = None
    entity_types: tuple[str, ...] = field(default=())


def validate_bounds(bounds) -> tuple[float, float, float, float]:
    """West, south, east, north: four finite numbers in order within the degrees of the globe; nothing counts as 0."""
    import math

    try:
        box = tuple(float(b or 0) for b in bounds)
    except (TypeError, ValueError):
        raise TypeError("bounds are [west, south, east, north], four finite numbers") from None
    if len(box) != 4 or not all(map(math.isfinite, box)):
        raise TypeError("bounds are [west, south, east, north], four finite numbers")
    w, s, e, n = box
    if not (-180 <= w < e <= 180 and -90 <= s < n <= 90):
        raise ValueError("bounds must be in order and within [-180, -90, 180, 90]")
    return box
