"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a key that is a hash of its id and a seed. Keys are uniform, so their leading digits
deal each source, however large, evenly to ranges; ranges are sorted within, and sums of the ranges
before one give the words before any row of its source. A source's budget is cut there: whole
epochs first, then the rows whose words lie below what is left, the row on the cut in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import WS, text_or_empty, written

#: Weights by rank of the source name, the most epochs of a source, and rows that a range aims at.
WEIGHTS, EPOCHS, RANGE_ROWS, MIN_RANGES, MAX_RANGES = (1, 2, 3), 3, 20_000, 256, 1 << 16
SEED = "mix-1"


def words(text):
    """Number of runs of characters that are not white space."""
    return F.length(F.regexp_replace(F.regexp_replace(text, f"[^{WS}]+", "x"), f"[{WS}]+", "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target double) from (source, source_size).

    Sources weigh by rank of their name (code points, null last). Each gets its share of all words
    by weight, at most epochs times its size; what is cut is shared again by weight. The rounds end
    when no source is above: each one raises the common rate, read back as three numbers.
    """
    # Sources are ranked in parallel ranges: rank in the range plus the counts of the ranges before.
    by_name = written(sizes.withColumn("z", F.col("source").isNull()).repartitionByRange("z", "source").sortWithinPartitions("z", "source").withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("at", 33)
    before = by_name.groupBy(part.alias("part")).agg(F.count("*").alias("c")).withColumn("base", F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = by_name.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.coalesce("base", F.lit(0)) + F.col("at") - F.shiftleft("part", 33))
    weighed = written(ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1).cast("long").alias("w")), "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rest, wsum, capped = total, weighed.agg(F.sum("w")).first()[0] or 0, 0
    while wsum:
        # Above its cap at the rate rest / wsum, in whole numbers.
        above = F.expr(f"cast({epochs} * source_size as decimal(38, 0)) * {wsum} < cast(w as decimal(38, 0)) * {rest}")
        now = weighed.filter(above).agg(F.count("*"), F.sum("w"), F.sum("source_size")).first()
        if now[0] == capped:
            break
        capped = now[0]
        rest, wsum = total - epochs * (now[2] or 0), (weighed.agg(F.sum("w")).first()[0] or 0) - (now[1] or 0)
        if not wsum:
            break
    if not wsum:
        return weighed.select("source", "source_size", (F.col("source_size") * epochs).cast("double").alias("target"))
    above = F.expr(f"cast({epochs} * source_size as decimal(38, 0)) * {wsum} < cast(w as decimal(38, 0)) * {rest}")
    return weighed.select("source", "source_size", F.when(above, (F.col("source_size") * epochs).cast("double")).otherwise(F.expr(f"cast({rest} * w as double) / cast({wsum} as double)")).alias("target"))


def taken(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """rows (u, doc_id, source, size) with source_size, target and taken; u tells rows apart.

    taken counts the words that the mix takes of the row, repeats included. A null source is a source
    of its own; rows of size 0 and sources without words take 0; rows that share an id are separate
    rows; an empty table gives no rows.
    """
    table = written(rows.select("u", "doc_id", "source", "size", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("k")), "mix-rows")
    sizes = table.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    n = table.count()
    digits = 2
    while 16**digits < min(MAX_RANGES, max(MIN_RANGES, n // RANGE_ROWS)):
        digits += 1
    goals = targets(sizes.select("source", "source_size"))
    keyed = table.withColumn("r", F.substring("k", 1, digits))
    ranges = keyed.groupBy("source", "r").agg(F.sum("size").alias("range_size"))
    # One row a range: MAX_RANGES of a source at most.
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_size")
    placed = ranges.withColumn("range_before", before).alias("a").join(goals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(F.col("a.source").alias("_s"), F.col("r").alias("_r"), "range_before", "source_size", "target")
    joined = keyed.join(placed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("r") == F.col("_r")))
    inside = F.sum("size").over(Window.partitionBy("source", "r").orderBy("k", "doc_id", "size", "u").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.floor("target") - F.col("epochs") * F.col("source_size")
    return (
        joined.withColumn("words_before", F.col("range_before") + inside)
        .withColumn("epochs", epochs)
        .select("u", "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("words_before")))).cast("long").alias("taken"))
    )


def digest(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("u"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(text_or_empty()).alias("size"))
    return taken(rows).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs as the mix holds them: a row for each epoch that takes it, and for the cut one its leading words.

    All columns are kept, whatever their names; text and n_chars (where present) of a cut row are
    shortened. Documents without words are kept once: they have no weight in the mix.
    """
    cols = docs.columns
    marked = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.monotonically_increasing_id().alias("u")), "mix-docs")
    rows = marked.select("u", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), words(F.coalesce("row.text", F.lit(""))).alias("size"))
    whole, part = F.expr("taken div size"), F.col("taken") % F.col("size")
    some = F.col("size") > 0
    got = taken(rows, seed).select("u", "size", F.when(some, whole).otherwise(0).alias("times"), F.when(some, part).otherwise(0).alias("part"))
    keyed = marked.join(got, "u")
    parts = F.expr("transform(sequence(1, cast(times as int)), x -> size)")
    whole = F.when(F.col("times") > 0, parts).otherwise(F.array().cast("array<bigint>"))
    takes = F.when(F.col("size") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.concat(whole, F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>"))))
    out = keyed.select("row", "size", F.explode(takes).alias("take"))
    # Words with the white space before each; only a cut row is split.
    short = F.expr("array_join(slice(split(row.text, '(?<=[^\\\\x20\\\\x09-\\\\x0D])(?=[\\\\x20\\\\x09-\\\\x0D])'), 1, cast(take as int)), '')")
    text = F.when(F.col("take") < F.col("size"), short).otherwise(F.col("row.text"))
    fields = []
    for c in cols:
        x = F.col("row").getField(c)
        if c == "text":
            x = text
        elif c == "n_chars":
            x = F.when(F.col("take") < F.col("size"), F.length(text).cast(docs.schema[c].dataType)).otherwise(x)
        fields.append(x.alias(c))
    return out.select(*fields)
