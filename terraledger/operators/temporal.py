"""Temporal assessment of observations and the choice of a representation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The sentence for each status.
REASONS = {
    "SUPERSEDED": "A later revision exists in the same explicit source lineage.",
    "DELETED_SOURCE_RECORD": "The latest explicit source revision is marked deleted; physical demolition is not asserted.",
    "UNRESOLVED_TEMPORAL_CONFLICT": "Independent active evidence conflicts; retrieval order is not used to pick a winner.",
    "STALE": "The observation exceeds the caller-supplied age policy; it is not asserted false.",
    "POSSIBLE_CHANGE": "A change signal exists but does not prove construction, demolition, or replacement.",
    "CURRENT": "Latest known non-deleted revision in its explicit source lineage.",
}
REPRESENTATION_RANK = {"observed": 0, "curated": 1, "procedural": 2, "synthetic": 3, "none": 4}


def instant_ms(c: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(F.nullif(c, F.lit(""))))


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _revision(df: DataFrame) -> Column:
    """The revision as a number: an empty text is 0, none and what is no number -1."""
    text = F.trim(_column(df, "revision", "string"))
    return F.coalesce(F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double")), F.lit(-1.0))


def assess(observations: DataFrame, now: str | None = None, stale_after_ms: int = 0, subject: str | None = None) -> DataFrame:
    """observations with status and reason.

    Columns: id, lineage_id, revision, observed_at, source_updated_at, valid_from, deleted,
    possible_change, fingerprint, value; those that are missing are null. All rows describe one thing,
    or one thing for each value of the subject column. In a lineage the latest row (revision, then
    time, then id) is current, or deleted; the others are superseded. Active rows of different
    lineages that differ conflict: decided by counting, without comparing pairs. Ages need now.
    """
    df = observations
    s = F.col(subject) if subject else F.lit(0)
    when = F.coalesce(*[F.nullif(_column(df, c, "string"), F.lit("")) for c in ("observed_at", "source_updated_at", "valid_from")])
    rows = df.withColumns(
        {
            "_s": s,
            "_l": F.coalesce(_column(df, "lineage_id", "string"), F.lit("")),
            "_r": _revision(df),
            "_t": F.coalesce(instant_ms(when), F.lit(-1)),
            "_known": instant_ms(when),
            "_d": F.coalesce(_column(df, "deleted", "boolean"), F.lit(False)),
            "_p": F.coalesce(_column(df, "possible_change", "boolean"), F.lit(False)),
            "_f": F.coalesce(_column(df, "fingerprint", "string"), F.lit("")),
            "_v": F.coalesce(_column(df, "value", "string"), F.lit("\u0000")),
        }
    )
    # Rows without lineage are ranked by nothing: they spread by id, so that they make no partition of their own.
    apart = F.when(F.col("_l") == "", F.xxhash64("id"))
    latest = Window.partitionBy("_s", "_l", apart).orderBy(F.desc("_r"), F.desc("_t"), F.desc("id"))
    first = F.when(F.col("_l") == "", 1).otherwise(F.row_number().over(latest))
    rows = rows.withColumn("_status", F.when(first > 1, "SUPERSEDED").when((F.col("_l") != "") & F.col("_d"), "DELETED_SOURCE_RECORD").otherwise("CURRENT"))
    # Of a subject's active rows one conflicts with another if they differ in deleted, else in fingerprints
    # where both have one, else in values. Each lineage has one active row, so counts decide:
    # rows of the other deleted flag; with a fingerprint, rows of another one, and rows without one of
    # another value; without, rows of another value.
    active = rows.filter("_status = 'CURRENT'").groupBy("_s", "_d", "_f", "_v").agg(F.count("*").alias("n"))
    by = lambda *c: active.groupBy(*c).agg(F.sum("n").alias("n_" + "".join(c).replace("_", "")))
    bare = active.filter("_f = ''")
    counted = rows
    for side in (by("_s"), by("_s", "_d"), by("_s", "_d", "_v"), by("_s", "_d", "_f"), bare.groupBy("_s", "_d").agg(F.sum("n").alias("bare")), bare.groupBy("_s", "_d", "_v").agg(F.sum("n").alias("bare_same"))):
        keys = [c for c in side.columns if c.startswith("_")]
        counted = counted.join(side, keys, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    flags = z("n_s") - z("n_sd")
    printed = (z("n_sd") - z("bare") - z("n_sdf")) + (z("bare") - z("bare_same"))
    plain = z("n_sd") - z("n_sdv")
    conflict = (F.col("_status") == "CURRENT") & (flags + F.when(F.col("_f") != "", printed).otherwise(plain) > 0)
    moment = instant_ms(F.lit(now)) if now else F.unix_millis(F.current_timestamp())
    old = (F.lit(stale_after_ms) > 0) & F.col("_known").isNotNull() & (moment - F.col("_known") > stale_after_ms)
    status = (
        F.when(F.col("_status") != "CURRENT", F.col("_status"))
        .when(conflict, "UNRESOLVED_TEMPORAL_CONFLICT")
        .when(F.col("_p"), "POSSIBLE_CHANGE")
        .when(F.coalesce(old, F.lit(False)), "STALE")
        .otherwise("CURRENT")
    )
    out = counted.withColumn("status", status)
    reason = F.lit(REASONS["CURRENT"])
    for k, v in REASONS.items():
        reason = F.when(F.col("status") == k, v).otherwise(reason)
    return out.withColumn("reason", reason).select(*df.columns, "status", "reason")


def representations(candidates: DataFrame, device_tier: float = 2, distance_m: float = 0) -> DataFrame:
    """candidates with eligible, rejection_reasons and rank within wanted_id.

    Columns: wanted_id (the entity asked for), id, entity_id, class, authorized, license_permits_use,
    minimum_device_tier, max_distance_m, available.
    """
    no = lambda c: F.coalesce(F.col(c) == F.lit(False), F.lit(False))
    reach = F.when(F.coalesce(F.col("max_distance_m").cast("double"), F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(F.col("max_distance_m").cast("double"))
    reasons = F.array_sort(
        F.array_compact(
            F.array(
                F.when(~F.col("entity_id").eqNullSafe(F.col("wanted_id")), "different-entity"),
                F.when(no("authorized"), "not-authorized"),
                F.when(no("license_permits_use"), "license-does-not-permit-use"),
                F.when(F.coalesce(F.col("minimum_device_tier").cast("double"), F.lit(0.0)) > float(device_tier or 2), "device-budget"),
                F.when(reach < float(distance_m or 0), "outside-lod-distance"),
                F.when(no("available"), "unavailable"),
            )
        )
    )
    rank = F.lit(99)
    for k, v in REPRESENTATION_RANK.items():
        rank = F.when(F.col("class") == k, v).otherwise(rank)
    out = candidates.withColumn("rejection_reasons", reasons).withColumn("eligible", F.size("rejection_reasons") == 0)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("wanted_id").orderBy(F.desc("eligible"), rank, "id")))


def select_representation(candidates: DataFrame, device_tier: float = 2, distance_m: float = 0) -> DataFrame:
    """(wanted_id, selected_id, selected_class): the first eligible candidate, else none."""
    r = representations(candidates, device_tier, distance_m)
    best = F.min_by(F.struct("id", "class"), F.when(F.col("eligible"), F.col("rank")))
    got = r.groupBy("wanted_id").agg(best.alias("b"), F.bool_or("eligible").alias("any"))
    return got.select("wanted_id", F.when(F.col("any"), F.col("b.id")).alias("selected_id"), F.when(F.col("any"), F.col("b.class")).otherwise("none").alias("selected_class"))
