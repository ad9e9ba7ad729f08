"""Candidate pairs: shared stable ids first, then a spatial join by grid cells.

Every box lies on the grid level whose cells are about its own size. A pair is found on the coarser of
its two levels, in the cell that holds the lower left corner of the boxes' intersection, so each pair
comes once without removing duplicates, and a large box costs a few cells, not thousands. There are two
equi-joins, one for pairs whose left box is as coarse or coarser, one for the others: so a box as large
as a continent meets every box in it, but those do not meet each other in its cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraledger.functions import geometry, text
from terraledger.types import RECONCILABLE_TYPES, Policy

#: Side of the finest cells in degrees, the factor from level to level, and cells that a box has on its level at most (per side).
FINEST, FACTOR, SIDE = 0.004, 8, 4
LEVELS = 7


def stable_ids(gers: Column, aliases: Column) -> Column:
    named = F.filter(F.coalesce(aliases, F.array().cast("array<struct<namespace:string,id:string>>")), lambda a: (F.coalesce(a["namespace"], F.lit("")) != "") & (F.coalesce(a["id"], F.lit("")) != ""))
    own = F.when(F.coalesce(gers, F.lit("")) != "", F.array(F.concat(F.lit("gers:"), gers))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, F.transform(named, lambda a: F.concat_ws(":", a["namespace"], a["id"]))))


def _first(props: Column, names: tuple[str, ...]) -> list[Column]:
    return [text.plain(props[n]) for n in names]


# Properties that are compared, in their order.
NAMES, ADDRESSES, KINDS = ("name", "ref"), ("address", "formattedAddress", "addr:full"), ("type", "category", "class", "subtype")


def prepared(records: DataFrame, ascii_only: bool = False) -> DataFrame:
    """What pairs are compared by: box, centre, ends, stable ids, and the word sets of compared properties."""
    rows = records.filter(F.col("entity_type").isin(*RECONCILABLE_TYPES))
    geom = geometry.parse(F.col("geometry"))
    rows = rows.select("id", "provider_id", "entity_type", "gers_id", "geometry", geom.alias("_g"), stable_ids(F.col("gers_id"), F.col("aliases")).alias("ids"), F.col("properties").alias("_p"))
    words = {g: F.array(*[F.when(v.isNotNull(), text.words(text.normalized(v, ascii_only))) for v in _first(F.col("_p"), names)]) for g, names in (("names", NAMES), ("addresses", ADDRESSES), ("kinds", KINDS))}
    exact = {c: text.normalized(text.plain(F.col("_p")[n]), ascii_only) for c, n in (("b_name", "name"), ("b_address", "address"), ("b_type", "type"))}
    part = F.coalesce(text.plain(F.col("_p")["buildingPart"]), text.plain(F.col("_p")["building:part"]), text.plain(F.col("_p")["role"]), F.lit(""))
    rows = rows.withColumn("box", geometry.bbox(F.col("_g"))).withColumn("kind", F.col("_g.type"))
    return rows.select(
        "id", "provider_id", "entity_type", "gers_id", "geometry", "kind", "box", "ids",
        geometry.center(F.col("box")).alias("c"),
        F.when(F.col("entity_type") == "road", geometry.endpoints(F.col("_g"))).alias("ends"),
        F.when(geometry.is_areal(F.col("kind")), geometry.area(F.col("_g"))).alias("area"),
        ((F.trim(part) != "") & (F.lower(part) != "no")).alias("is_part"),
        *[v.alias(k) for k, v in words.items()],
        *[v.alias(k) for k, v in exact.items()],
    )


def _size(level: Column) -> Column:
    return F.lit(FINEST) * F.pow(F.lit(float(FACTOR)), level)


def own_level(box: Column) -> Column:
    side = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"], F.lit(FINEST))
    return F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log(side / (FINEST * SIDE)) / math.log(FACTOR)))).cast("int")


def cells(box: Column, level: Column) -> Column:
    """ARRAY<STRUCT level, x, y> of the cells that the box meets from its level up."""

    def at(lv: Column) -> Column:
        s = _size(lv)
        span = lambda a, b: F.sequence(F.floor(box[a] / s), F.floor(box[b] / s))
        return F.flatten(F.transform(span("x0", "x1"), lambda x: F.transform(span("y0", "y1"), lambda y: F.struct(lv.cast("int").alias("level"), x.alias("x"), y.alias("y")))))

    return F.flatten(F.transform(F.sequence(level, F.lit(LEVELS)), at))


def _levels(boxed: DataFrame) -> list[int]:
    """The levels on which any box lies: LEVELS + 1 small numbers at most."""
    return sorted(r[0] for r in boxed.select("level").distinct().collect()) or [0]


def radius(kind: Column, policies: dict[str, Policy]) -> Column:
    out = F.when(F.lit(False), 0.0)
    for t, p in policies.items():
        out = out.when(kind == t, float(p.radius_m))
    return out


def shuffled(side: DataFrame) -> DataFrame:
    """The side of a join that is not broadcast: of records in Parquet the planner knows the packed size only, a small part of what they take."""
    return side.hint("merge")


def in_one_cell(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with equal keys and a cell in common, of the coarser of their levels: l, r, their boxes and levels, and the cell."""
    a, b = (d.filter("box is not null").withColumn("level", own_level(F.col("box"))) for d in (left, right))
    on_left, on_right = _levels(a), _levels(b)

    def dealt(d: DataFrame, name: str, keep) -> DataFrame:
        return d.select(*[F.col(k) for k in keys], F.explode(F.filter(cells(F.col("box"), F.col("level")), keep)).alias("cell"), F.col("row").alias(name), F.col("box").alias(f"{name}_box"), F.col("level").alias(f"{name}_level"))

    # A cell holds the boxes of its own level of one side only, with whatever of the other lies in it: what is
    # small on both sides meets in small cells, however large some other boxes are.
    own = lambda level: lambda c: c["level"] == level
    wide = dealt(a, "l", own(F.col("level"))).join(shuffled(dealt(b, "r", lambda c: c["level"].isin(*on_left))), [*keys, "cell"])
    narrow = dealt(a, "l", lambda c: (c["level"] > F.col("level")) & c["level"].isin(*on_right)).join(shuffled(dealt(b, "r", own(F.col("level")))), [*keys, "cell"])
    return wide.unionByName(narrow)


def box_pairs(left: DataFrame, right: DataFrame, keys: list[str], extra: Column | None = None) -> DataFrame:
    """Pairs (l, r) of structs whose boxes meet, with equal keys. Both sides have columns row, box and the keys; box null never meets."""
    s = _size(F.col("cell.level"))
    corner = lambda c, i: F.floor(F.greatest(F.col(f"l_box.{c}"), F.col(f"r_box.{c}")) / s) == F.col(f"cell.{i}")
    joined = in_one_cell(left, right, keys).filter(geometry.boxes_meet(F.col("l_box"), F.col("r_box")) & corner("x0", "x") & corner("y0", "y"))
    return joined.filter(extra) if extra is not None else joined


def candidates(left: DataFrame, right: DataFrame, policies: dict[str, Policy], ordered: bool = False) -> DataFrame:
    """(pair, l, r, stable): candidate pairs of prepared records. pair names the two providers.

    A left record with a stable id in common with any record of a provider is compared with those
    records only; else with those whose boxes meet its own, grown by its type's radius. With ordered,
    both sides are the same records and pairs go from a provider to a later one.
    """
    row = lambda d: F.struct(*[F.col(c) for c in d.columns]).alias("row")
    apart = (F.col("l.provider_id") < F.col("r.provider_id")) if ordered else F.lit(True)
    pair = F.struct(F.col("l.provider_id").alias("l"), F.col("r.provider_id").alias("r")) if ordered else F.struct(F.lit("left").alias("l"), F.lit("right").alias("r"))
    lid, rid = (d.filter(F.size("ids") > 0).select("entity_type", F.explode("ids").alias("ident"), row(d)) for d in (left, right))
    shared = lid.withColumnRenamed("row", "l").join(shuffled(rid.withColumnRenamed("row", "r")), ["entity_type", "ident"]).filter(apart)
    shared = shared.withColumn("pair", pair).groupBy("pair", F.col("l.id").alias("lid"), F.col("r.id").alias("rid")).agg(F.first("l").alias("l"), F.first("r").alias("r"), F.min("ident").alias("stable"))
    grown = left.select(F.col("entity_type").alias("k"), row(left), F.when(F.col("box").isNotNull(), geometry.expanded(F.col("box"), radius(F.col("entity_type"), policies))).alias("box"))
    near = box_pairs(grown, right.select(F.col("entity_type").alias("k"), row(right), "box"), ["k"], apart)
    near = near.select(pair.alias("pair"), F.col("l.id").alias("lid"), "l", "r")
    near = near.join(shuffled(shared.select("pair", "lid").distinct()), ["pair", "lid"], "left_anti")
    return shared.select("pair", "l", "r", "stable").unionByName(near.select("pair", "l", "r", F.lit(None).cast("string").alias("stable")))
