"""Exact dedup with a two-pass Bloom filter, in DataFrame functions only.

Pass 1 hashes every text to HASHES bit positions of a filter and keeps a bit where two rows or more
met: the filter of possibly repeated hashes. Pass 2 tests every row against it, bit words broadcast.
The filter grows with the rows, BITS_PER_ROW each, so it never fills up: beyond MAX_BITS the hashes
are dealt to slices by their value, and each slice has a filter and a broadcast of its own (HASHES *
MAX_BITS / 8 bytes at most), one after another. A row with a clear bit is alone and passes straight
through; only the others shuffle, and grouping their SHA-256 settles them. Groups are aggregated
before the shuffle, and the few that could hold a large share of the rows are joined by broadcast, so
a group of copies never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import WS, new_path, text_or_empty, written

#: Bits a row, and bounds of a table of the filter. There are HASHES tables.
BITS_PER_ROW, MIN_BITS, MAX_BITS, HASHES = 16, 1 << 16, 1 << 26, 2
#: Bits in one stored word of the filter, and the share of rows from which a group is joined by broadcast.
WORD, HOT = 32 * 32, 100
#: Repeated hashes of 8 bytes that are broadcast at most; beyond, rows are joined with them by shuffle.
BROADCAST_HASHES = 4_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]+", " ")


def _bits(rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (max(1, rows * BITS_PER_ROW) - 1).bit_length()))


def _slices(rows: int) -> int:
    """Filters that hold BITS_PER_ROW for every row."""
    return max(1, -(-rows * BITS_PER_ROW // MAX_BITS))


def _position(h: Column, i: int, bits: int) -> Column:
    """The i-th of HASHES bit positions, from other bits of the hash each time."""
    return F.pmod(F.xxhash64(h, F.lit(i)), F.lit(bits)).cast("long")


def repeated_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """(t, word, set): for table t, the words that hold a position met by two rows or more.

    set is an array of 32 ints of 32 bits each. At most HASHES * bits / WORD rows.
    """
    met = hashes.select(F.explode(F.array(*[F.struct(F.lit(i).alias("t"), _position(F.col("h"), i, bits).alias("at")) for i in range(HASHES)])).alias("p")).groupBy("p.t", "p.at").count().filter("count > 1")
    at, lane = F.col("at"), F.pmod(F.col("at"), F.lit(WORD)).cast("int")
    bit = F.expr("shiftleft(1L, cast(at % 32 as int))")
    lanes = [F.coalesce(F.bit_or(F.when((lane / 32).cast("int") == j, bit)), F.lit(0)).alias(f"l{j}") for j in range(WORD // 32)]
    return met.groupBy("t", F.expr(f"at div {WORD}").alias("word")).agg(*lanes).select("t", "word", F.array(*[f"l{j}" for j in range(WORD // 32)]).alias("set"))


def maybe_repeated(rows: DataFrame, filt: DataFrame, bits: int) -> DataFrame:
    """rows (with h) and a boolean maybe: false only where no other row has the same h."""
    out = rows
    for i in range(HASHES):
        words = F.broadcast(filt.filter(F.col("t") == i).select(F.col("word").alias(f"_w{i}"), F.col("set").alias(f"_s{i}")))
        out = out.withColumn(f"_p{i}", _position(F.col("h"), i, bits)).withColumn(f"_d{i}", F.expr(f"_p{i} div {WORD}"))
        out = out.join(words, F.col(f"_d{i}") == F.col(f"_w{i}"), "left")
    on = [F.coalesce(F.expr(f"getbit(element_at(_s{i}, cast((_p{i} % {WORD}) div 32 as int) + 1), cast(_p{i} % 32 as int)) = 1"), F.lit(False)) for i in range(HASHES)]
    test = on[0]
    for x in on[1:]:
        test = test & x
    return out.withColumn("maybe", test).drop(*[f"{c}{i}" for i in range(HASHES) for c in ("_p", "_d", "_w", "_s")])


def screened(rows: DataFrame, n: int, name: str) -> DataFrame:
    """The n rows (with h, a written table) and maybe, as a written table; slice by slice where one filter is too small."""
    bits, slices = _bits(n), _slices(n)
    if slices == 1:
        return written(maybe_repeated(rows, repeated_filter(rows.select("h"), bits), bits), name)
    path = new_path(rows.sparkSession, name)
    for i in range(slices):
        own = rows.filter(F.pmod(F.xxhash64("h", F.lit(HASHES)), F.lit(slices)) == i)
        tested = maybe_repeated(own, repeated_filter(own.select("h"), bits), bits)
        tested.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(tested.schema).parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. A null doc_id comes after all others; of rows that share text and
    doc_id, one stays. An empty table gives no rows. Extra columns are not carried.
    """
    text = normalised(text_or_empty())
    hashed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("s"), F.monotonically_increasing_id().alias("u")).withColumn("h", F.xxhash64("s")), "exact")
    n = hashed.count()
    tested = screened(hashed.withColumn("s", F.unhex("s")), n, "exact-tested").drop("h")
    cand = tested.filter("maybe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "u")).alias("f")
    groups = written(cand.groupBy("s").agg(F.count("*").alias("n"), first).select("s", "n", F.col("f.doc_id").alias("keep_id"), F.col("f.u").alias("keep_u")), "exact-groups")
    # A group of a hundredth of all rows or more: there are at most HOT of them.
    hot = F.broadcast(groups.filter(F.col("n") * HOT >= max(n, 1)))
    rest = groups.filter((F.col("n") * HOT < max(n, 1)) & (F.col("n") > 1))
    warm = cand.join(hot, "s")
    cold = cand.join(hot.select("s"), "s", "left_anti").join(rest, "s", "left")
    alone = tested.filter("not maybe").select("s", "doc_id", "u", "maybe", F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("keep_id"), F.col("u").alias("keep_u"))
    out = alone.unionByName(warm).unionByName(cold.select("s", "doc_id", "u", "maybe", F.coalesce("n", F.lit(1)).alias("n"), F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("keep_u", "u").alias("keep_u")))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("u") == F.col("keep_u")).alias("kept"), F.lower(F.hex("s")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without repeated texts: of equal ones the row with the smallest id stays, all its columns as they were.

    Null text counts as empty, a null id comes last, one of rows equal in both stays, an empty table
    stays empty, and columns of any name are kept. The hashes that the filter finds are counted, and the
    repeated ones are broadcast where BROADCAST_HASHES of them suffice: then rows of a text of their own
    are neither shuffled nor grouped, and the rest are reduced to one row a text within each task before
    they shuffle.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.sha2(normalised(text_or_empty(f"`{text_col}`")), 256).alias("s"), F.col(f"`{id_col}`").alias("i")).withColumn("h", F.xxhash64("s"))
    hashes = written(docs.select(F.xxhash64(F.sha2(normalised(text_or_empty(f"`{text_col}`")), 256)).alias("h")), "exact-hashes")
    maybe = screened(hashes, hashes.count(), "exact-screened").filter("maybe")
    repeated = written(maybe.groupBy("h").count().filter("count > 1").select(F.col("h").alias("rh")), "exact-repeated")
    few = repeated.count() <= BROADCAST_HASHES
    tested = inner.join(F.broadcast(repeated) if few else repeated, F.col("h") == F.col("rh"), "left").withColumn("maybe", F.col("rh").isNotNull()).drop("rh")
    order = F.struct(F.col("i").isNull().alias("z"), "i", F.xxhash64(F.to_json("row")).alias("tie"))
    survivors = tested.filter("maybe").groupBy("s").agg(F.min_by("row", order).alias("row"))
    return tested.filter("not maybe").select("row").unionByName(survivors.select("row")).select("row.*")
