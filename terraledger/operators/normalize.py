"""Raw records to source records: one projection that transforms, validates, bounds, and attaches provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraledger.functions import crs, geometry, overlap, text
from terraledger.types import ENTITY_TYPES, EVIDENCE_CLASSES, TIMES, Limits


def evidence_class(c: Column) -> Column:
    return F.when(c.isin(*EVIDENCE_CLASSES), c).otherwise("UNKNOWN")


def evidence_rank(c: Column) -> Column:
    """0 is the strongest class; an unknown one ranks last."""
    out = F.when(F.lit(False), 0)
    for i, name in enumerate(EVIDENCE_CLASSES):
        out = out.when(c == name, i)
    return out.otherwise(len(EVIDENCE_CLASSES) - 1)


def _or(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def fail_if(bad: Column, message: Column, value: Column) -> Column:
    return F.when(bad, F.raise_error(message).cast("string")).otherwise(value)


def sorted_texts(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>")))))


def clean_properties(p: Column) -> Column:
    """Without values that are null or JSON null."""
    return F.map_filter(F.coalesce(p, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (v != "null"))


def provenance(source: dict, source_id: Column, fields: dict[str, Column]) -> Column:
    """The provenance of one record; its id goes by source, dataset, record and activity only."""
    activity = fields["activity"]
    ident = text.sha(F.lit(source["id"]), F.lit(source["dataset_id"]), source_id, F.coalesce(F.to_json(activity), F.lit("null")))
    s = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        F.concat(F.lit("provenance:"), ident).alias("id"),
        F.lit(source["id"]).alias("provider_id"),
        F.lit(source["operator"]).alias("operator"),
        F.lit(source["dataset_id"]).alias("dataset_id"),
        _or(fields["dataset_version"], F.lit(source["dataset_version"]), F.lit("unknown")).alias("dataset_version"),
        source_id.alias("source_record_id"),
        text.redact_url(_or(fields["source_url"], F.lit(source.get("source_url", "")))).alias("source_url"),
        _or(fields["license_id"], F.lit(source["license_id"]), F.lit("unknown")).alias("license_id"),
        _or(fields["attribution"], F.lit(source["attribution"])).alias("attribution"),
        _or(fields["source_crs"], F.lit("unknown")).alias("source_crs"),
        F.lit(crs.OUTPUT).alias("output_crs"),
        *[s(fields[t]).alias(t) for t in TIMES],
        activity.alias("activity"),
        _or(fields["privacy"], F.lit(source["privacy"]), F.lit("public")).alias("privacy"),
        sorted_texts(fields["warnings"]).alias("warnings"),
    )


def normalize(raw: DataFrame, source: dict, limits: Limits = Limits(), retrieved_at: str = "", quarantine: bool = False) -> DataFrame:
    """Source records of one source. source has id, dataset_id, operator, license_id and so on.

    A record without id, type or coordinate system, with too many or too large properties, or with
    positions that are no numbers raises, which fails the source; with quarantine such rows are
    kept with a reason in invalid instead. A geometry that is not valid moves to rejected_geometry.
    """
    sid = F.trim(F.coalesce("source_id", F.lit("")))
    kind = F.lower(F.coalesce("entity_type", F.lit("")))
    system = F.upper(_or(F.col("source_crs"), F.lit(source["source_crs"])))
    props = clean_properties(F.col("properties"))
    label = F.concat(F.lit("source record "), sid)
    found = F.when((sid == "") | ~kind.isin(*ENTITY_TYPES), F.lit("source record requires an id and a supported type"))
    found = found.when(system == "", F.concat(label, F.lit(" has no declared coordinate system")))
    found = found.when(F.size(props) > limits.max_properties, F.concat(label, F.lit(f" exceeds {limits.max_properties} properties")))
    found = found.when(F.octet_length(F.to_json(props)) > limits.max_property_bytes, F.concat(label, F.lit(f" exceeds {limits.max_property_bytes} bytes of properties")))
    found = found.when(F.exists(F.map_values(props), lambda v: F.try_parse_json(v).isNull()), F.concat(label, F.lit(" has a property that is no JSON value")))
    base = raw.withColumn("_sid", sid).withColumn("_kind", kind).withColumn("_crs", system).withColumn("_props", props).withColumn("invalid", found)
    if not quarantine:
        base = base.withColumn("_sid", fail_if(F.col("invalid").isNotNull(), F.col("invalid"), F.col("_sid")))
    base = base.withColumn("_geo", F.when(F.col("invalid").isNull(), crs.transform_geojson(F.col("geometry"), F.col("_crs"))))
    base = base.withColumn("_valid", overlap.validate(F.col("_geo"), limits.max_coordinates))
    none = F.struct(F.lit(True).alias("valid"), F.lit(0).alias("coordinate_count"), F.array().cast("array<string>").alias("warnings"))
    base = base.withColumn("_valid", F.when(F.col("_geo").isNull(), none).otherwise(F.col("_valid")))
    stamp = F.when(
        F.col("_crs") != crs.OUTPUT,
        F.struct(
            F.concat(F.lit("crs-transform:"), F.col("_crs"), F.lit(f":{crs.OUTPUT}")).alias("id"),
            F.lit("coordinate-transform").alias("method"),
            F.lit("1").alias("version"),
            F.array(F.concat(F.lit(source["id"] + ":"), F.col("_sid"))).alias("input_ids"),
        ),
    )
    fields = {c: F.col(c) for c in raw.columns} | {
        "source_crs": F.col("_crs"),
        "activity": F.coalesce("activity", stamp),
        "warnings": F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.col("_valid.warnings")),
        "retrieved_at": _or(F.col("retrieved_at"), F.lit(retrieved_at)),
    }
    ok = F.col("_valid.valid")
    keys = F.array_sort(F.map_keys("_props"))
    flat = F.to_json(F.transform(keys, lambda k: F.array(k, F.col("_props")[k])))
    return base.select(
        F.concat(F.lit(f"source:{source['id']}:"), F.col("_sid")).alias("id"),
        F.lit(source["id"]).alias("provider_id"),
        F.lit(source["dataset_id"]).alias("dataset_id"),
        F.col("_sid").alias("source_id"),
        F.col("_kind").alias("entity_type"),
        F.when(ok, F.col("_geo")).alias("geometry"),
        F.when(~ok, F.col("_geo")).alias("rejected_geometry"),
        F.col("_valid").alias("geometry_validation"),
        F.col("_props").alias("properties"),
        F.coalesce("aliases", F.array().cast("array<struct<namespace:string,id:string>>")).alias("aliases"),
        F.coalesce("gers_id", F.lit("")).alias("gers_id"),
        evidence_class(F.col("evidence_class")).alias("evidence_class"),
        provenance(source, F.col("_sid"), fields).alias("provenance"),
        text.sha(F.lit(source["id"]), F.col("_sid"), F.col("_kind"), F.col("_geo"), flat).alias("fingerprint"),
        *([F.col("invalid")] if quarantine else []),
    )


def box_columns(records: DataFrame) -> DataFrame:
    """records with xmin, ymin, xmax, ymax as plain columns, which Parquet can prune by."""
    b = geometry.bbox(geometry.parse(F.col("geometry")))
    return records.withColumn("_b", b).select("*", *[F.col(f"_b.{a}").alias(c) for a, c in (("x0", "xmin"), ("y0", "ymin"), ("x1", "xmax"), ("y1", "ymax"))]).drop("_b")
