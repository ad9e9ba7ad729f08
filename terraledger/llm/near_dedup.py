"""Near-duplicate documents with b-bit MinHash, every link confirmed on the full shingle sets.

1. One pass over the texts gives each document its set size, a fingerprint of its set, the low bits
   of its minima packed in a signature, and hashes of its bands. Documents of equal sets become one
   class; only classes go on.
2. In every band bucket the classes hang on the smallest one (one edge a member, no pairs). The
   components of these edges are clusters: whatever can be linked lies in one cluster.
3. A cluster is cut into blocks of bounded size, and a task sees two blocks. It compares all their
   packed signatures by bit counts, corrected for chance agreement of the low bits, and confirms the
   likely pairs that are not yet connected on the full sets. It returns a spanning forest of the
   links, never pairs. Nothing is capped: a larger cluster only has more blocks.
4. The components of the confirmed links are the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraledger.operators.components import components

from .runtime import arrow_rows, text_or_empty, written
from .textstats import mixed, windows

#: Classes and shingles that a block has about at most; ids of clustered classes that may be broadcast (32 bytes each).
BLOCK_CLASSES, BLOCK_SHINGLES, BROADCAST_IDS = 800, 400_000, 2_000_000
SEED = 20_240_501


@dataclass(frozen=True)
class Params:
    """Words of a shingle and the link threshold in percent; bands and rows of minima, and the bits kept of each.

    48 bands of 8 minima miss a pair at 0.85 with a chance of 2e-7 each, at 0.8 with 1e-4.
    """

    words: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 8
    bits: int = 4

    @property
    def k(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        """Five deviations of the estimate below the threshold."""
        j, c = self.percent / 100, 2.0**-self.bits
        p = c + (1 - c) * j
        return j - 5 * (p * (1 - p) / self.k) ** 0.5 / (1 - c)


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of all words where there are fewer; empty without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    out = windows(h, min(n, len(words)))
    if len(words) < n:
        out = mixed(out ^ np.uint64(len(words)))
    return np.unique(out)


def multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)


def minima(s: np.ndarray, mul: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (mul[:, None] * low[None, at : at + 512]).min(axis=1), out=out)
    return out


def packed_bits(m: np.ndarray, bits: int) -> bytes:
    """The minima's low bits (above the lowest 8, which a product mixes least), side by side."""
    x = ((m >> np.uint32(8)) & np.uint32((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(x[:, None], axis=1)[:, 8 - bits :].reshape(-1)).tobytes()


def agreeing(a: np.ndarray, b: np.ndarray, bits: int, k: int) -> np.ndarray:
    """Share of agreeing minima of packed signatures (uint64 words), each of a with each of b."""
    if 64 % bits:
        raise ValueError("bits must divide 64")
    lane = np.uint64(sum(1 << i for i in range(0, 64, bits)))
    out = np.zeros((len(a), len(b)), np.int32)
    for w in range(a.shape[1]):
        x = a[:, w, None] ^ b[None, :, w]
        y = x
        for i in range(1, bits):
            y = y | (x >> np.uint64(i))
        out += np.bitwise_count(y & lane)
    return 1 - out / k


def corrected(share: np.ndarray, bits: int) -> np.ndarray:
    """Similarity from the share of agreeing b-bit minima, less what agrees by chance."""
    c = 2.0**-bits
    return (share - c) / (1 - c)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """(u, doc_id, th, n_shingles, fp, sig, bands) of every row; th hashes the text; fp, sig and bands are null without words."""
    mul = multipliers(p.k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n, fp, sig, bands = [], [], [], []
                for t in part.column(3).to_pylist():
                    s = shingles(t, p.words)
                    n.append(len(s))
                    if not len(s):
                        fp.append(None), sig.append(None), bands.append(None)
                        continue
                    m = minima(s, mul)
                    fp.append(hashlib.md5(s.tobytes()).digest())
                    sig.append(packed_bits(m, p.bits))
                    rows = m.reshape(p.bands, p.rows).astype(np.uint64)
                    h = np.arange(1, p.bands + 1, dtype=np.uint64)
                    for j in range(p.rows):
                        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
                    bands.append(h.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["u", "doc_id", "th", "n_shingles", "fp", "sig", "bands"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("u"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "u long, doc_id long, th long, n_shingles long, fp binary, sig binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """wanted (node, id, th, fp, ...) with the shingle set of a document of that id, text hash and fingerprint.

    Rows without id, or that share one, meet their own text only. A task gives a node once, however
    many rows repeat its id and text.
    """
    names = wanted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_fp, at_node, done = names.index("fp"), names.index("node"), set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets, good = [], []
                for text, node, fp in zip(part.column(len(names)), part.column(at_node).to_pylist(), part.column(at_fp).to_pylist()):
                    s = np.zeros(0, np.uint64) if node in done else shingles(text.as_py(), p.words)
                    sets.append(s)
                    good.append(node not in done and hashlib.md5(s.tobytes()).digest() == fp)
                    if good[-1]:
                        done.add(node)
                cols = [*part.columns[: len(names)], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, [*names, "s"]).filter(pa.array(good))

    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64(text_or_empty()).alias("_th"), text_or_empty().alias("_text"))
    rows = texts.join(wanted, F.col("_d").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th"))).select(*names, "_text")
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema) + ", s array<long>")


def linked(nodes: np.ndarray, first: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], cross: bool, p: Params) -> list[tuple[int, int]]:
    """A spanning forest of the links between classes: of different blocks if cross (first: those of the one block)."""
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    left = np.flatnonzero(first) if cross else np.arange(len(nodes))
    right = np.flatnonzero(~first) if cross else np.arange(len(nodes))
    size = np.array([len(s) for s in sets])
    found = []
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        est = corrected(agreeing(sigs[rows], sigs[right], p.bits, p.k), p.bits)
        fits = 100 * np.minimum(size[rows, None], size[None, right]) >= p.percent * np.maximum(size[rows, None], size[None, right])
        i, j = np.nonzero((est >= p.least_estimate) & fits & ((rows[:, None] < right[None, :]) | cross))
        found.append(np.stack([est[i, j], rows[i], right[j]], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 3))
    pairs = pairs[np.argsort(-pairs[:, 0], kind="stable")]
    out = []
    for i, j in pairs[:, 1:].astype(int).tolist():
        a, b = find(i), find(j)
        if a == b:
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * both >= p.percent * (size[i] + size[j] - both):
            parent[max(a, b)] = min(a, b)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _links(members: DataFrame, p: Params) -> DataFrame:
    """Confirmed links (a, b) from members (cluster, node, block, blocks, sig, s)."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.select("cluster", "node", "block", "sig", "s", other).select("cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "block", "sig", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> list[tuple[int, int]]:
            once = {r[0]: r for r in held}  # a node may come twice where rows share an id
            rows = [once[n] for n in sorted(once)]
            if len(rows) < 2:
                return []
            nodes = np.array([r[0] for r in rows])
            sigs = np.stack([np.frombuffer(r[2], np.uint8) for r in rows])
            pad = -sigs.shape[1] % 8
            sigs = np.pad(sigs, ((0, 0), (0, pad))).view(np.uint64)
            return linked(nodes, np.array([r[1] == key[1] for r in rows]), sigs, [r[3] for r in rows], key[1] != key[2], p)

        def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

        for b in batches:
            cluster, x, y = (b.column(i).to_pylist() for i in range(3))
            node, block, sig = (b.column(i).to_pylist() for i in (3, 4, 5))
            lists = b.column(6)
            values, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            out = []
            for i in range(b.num_rows):
                if (now := (cluster[i], x[i], y[i])) != key:
                    out += close() if key else []
                    key, held = now, []
                held.append((node[i], block[i], sig[i], values[ends[i] : ends[i + 1]].copy()))
            if out:
                yield batch(out)
        if key and (out := close()):
            yield batch(out)

    return dealt.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y").mapInArrow(run, "a long, b long")


def _placed(docs: DataFrame, p: Params) -> DataFrame:
    """Per row: doc_id, th, n_shingles, and best: the least (z, id, th) of its component, z telling a null id; null without words."""
    sigs = written(signatures(docs, p), "near-signatures")
    some = sigs.filter("fp is not null")
    classes = written(some.groupBy("fp").agg(F.min("u").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), "th")).alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")), "near-classes")
    keys = classes.select("node", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("c")).filter("c > 1").drop("c")
    stars = keys.join(hubs, "key").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = written(components(stars, "near-stars"), "near-clusters")
    sizes = clusters.join(classes.select("node", "n"), "node").groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    blocks = sizes.select(F.col("component").alias("cluster"), F.greatest(F.ceil(F.col("c") / BLOCK_CLASSES), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    wanted = written(
        clusters.withColumnRenamed("component", "cluster").join(blocks, "cluster").join(classes.select("node", "rep.id", "rep.th", "fp", "sig"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "near-wanted"
    )
    lookup = F.broadcast(wanted) if wanted.count() * (p.k * p.bits // 8 + 64) <= BROADCAST_IDS * 32 else wanted
    with arrow_rows(docs.sparkSession, 1000):  # a row has a whole shingle set
        links = written(_links(_sets(docs, lookup, p), p), "near-links")
    joined = written(components(links, "near-components"), "near-components-done")
    # A class's component, and the best row in it. Both sides of the join are written, so that AQE splits a hot component.
    placed = written(classes.select("fp", "node", "rep").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-placed")
    least = written(placed.groupBy("component").agg(F.min("rep").alias("best")), "near-least")
    by_class = written(placed.join(least, "component").select("fp", "best"), "near-best")
    # The join below has a row a class on its small side, and AQE splits a hot class.
    out = some.select("doc_id", "th", "n_shingles", "fp").join(by_class, "fp").select("doc_id", "th", "n_shingles", "best")
    return out.unionByName(sigs.filter("fp is null").select("doc_id", "th", "n_shingles"), allowMissingColumns=True)


def resolve(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Null text counts as empty; a row without words is linked with nothing. Rows that share an id are
    one document where kept is concerned: component_id is theirs. A row without id has a component_id
    only if it is linked to one that has an id, and is then not kept. An empty table gives no rows.
    Extra columns are not carried.
    """
    rows = _placed(docs, p).select("doc_id", "n_shingles", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.id")).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def near_dedup(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs less the near-duplicates: of each component one row stays, with all its columns.

    It is the one of the smallest id, a null id last; rows that share an id go by a hash of the text,
    rows that share both by a hash of the whole row. Rows without words all stay. Texts do not shuffle
    while the marked keys fit a broadcast of BROADCAST_IDS rows.
    """
    rows = written(_placed(docs, p).filter("best is not null").groupBy("doc_id", "th").agg(F.first("best").alias("best"), F.count("*").alias("n")), "near-rows")
    best = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), "th") == F.col("best")
    marks = written(rows.select(F.col("doc_id").alias("_i"), F.col("th").alias("_h"), best.alias("stays"), "n").filter("not stays or n > 1"), "near-marks")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(whole, F.col("doc_id").cast("long").alias("_d"), F.xxhash64(text_or_empty()).alias("_t"))
    marked = keyed.join(marks, F.col("_d").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_h")), "left")
    once = marked.filter("stays").groupBy("_d", "_t").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return marked.filter("stays is null").select("row").unionByName(once.select("row")).select("row.*")
