"""Packing token streams into windows with Karmarkar-Karp multiway differencing.

Documents longer than a window give full windows of their own, cut from their front; what is left
of each (its tail) is balanced. A block of tails is dealt to k windows by differencing: every tail
starts as a partial partition (one window holds it, k - 1 are empty), and the two partial
partitions of the largest spread are merged again and again, the fullest windows of one onto the
emptiest of the other, so that opposing imbalances cancel. k starts at the least count that could
hold the block and rises while a window is over capacity; since texts may be cut, tails are first
cut to quarters of a window, which keeps k at that least count or one above it.
Blocks are made of the rows of one task in order, so no row is shuffled. Full windows leave at once;
only tails, shorter than a window each, wait for their block, so memory is bounded by a portion of
encoded text and a block of tails, whatever the sizes of documents or sources.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import text_or_empty
from .tokens import CACHE_WORDS, encoder, packed, portions

#: Tails that one block balances at least, windows that they fill at least (so that the last, partly
#: filled one weighs little), and the part of a window that their pieces have at most.
BLOCK, FILL, CUT = 256, 16, 4
#: Bytes of text that are encoded at once, and pieces that are handed on at once; fewer where they carry their ids.
PORTION, PORTION_IDS = 4 << 20, 1 << 20
PIECES, PIECES_IDS = 4096, 128


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items to k windows: lists of indexes, by Karmarkar-Karp differencing. Ties go by index.

    A partial partition is k sums in falling order and, for each, the node that holds its items: 0 for
    none, i + 1 for item i, a later number for the two nodes that were put together.
    """
    if k <= 1:
        return [list(range(len(sizes)))] if k else []
    heap, joined, first = [], [], len(sizes) + 1
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.zeros(k, np.int64)
        sums[0], nodes[0] = s, i + 1
        heap.append((-s, i, sums, nodes))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, x = heapq.heappop(heap)
        _, j, b, y = heap[0]
        y = y[::-1]
        sums, nodes = a + b[::-1], x + y
        for at in np.flatnonzero(x * y):
            joined.append((int(x[at]), int(y[at])))
            nodes[at] = first + len(joined) - 1
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), min(i, j), sums, nodes[order]))

    def items(node: int) -> list[int]:
        out, todo = [], [node] * (node > 0)
        while todo:
            n = todo.pop()
            if n < first:
                out.append(n - 1)
            else:
                todo += joined[n - first]
        return out

    return [items(int(n)) for n in heap[0][3]] if heap else []


def balanced(tails: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (doc, start, length), none over the capacity, from tails shorter than a window."""
    total, size = sum(t[2] for t in tails), max(1, window // CUT)
    pieces = [(d, s + at, min(size, n - at)) for d, s, n in tails for at in range(0, n, size)]
    sizes, k = [p[2] for p in pieces], -(-total // window)
    while k:
        parts = differencing(sizes, k)
        if max(sum(sizes[i] for i in part) for part in parts) <= window:
            return [[pieces[i] for i in sorted(part)] for part in parts if part]
        k += 1
    return []


def pack(docs: DataFrame, tokenizer: str, *, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, keep_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (and ids).

    A null or empty text has only its end id. Rows that share a doc_id, null included, are separate
    documents. Each id lies in exactly one piece; pieces of a sequence lie gapless from offset 0. An
    empty table gives no rows. Extra columns are not carried.
    """
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        most_rows, portion = (PIECES_IDS, PORTION_IDS) if keep_ids else (PIECES, PORTION)
        enc, end, made = encoder(tokenizer, cache_words), packed([end_id]), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        tails: list[tuple[int, int, int]] = []
        held: list[tuple[int | None, int, bytes]] = []  # of each tail: doc_id, its document's ids, its own ids
        waiting = 0

        def put(doc_id: int | None, total: int, start: int, part: bytes, offset: int) -> None:
            rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total, made, offset) + ((np.frombuffer(part, np.uint32),) if keep_ids else ()))

        def batch() -> pa.RecordBatch:
            names = [*cols, "ids"] if keep_ids else cols
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32()) if c == "ids" else pa.int64()) for c, x in zip(names, zip(*rows))], names)
            rows.clear()
            return out

        def close() -> None:
            nonlocal made, waiting
            for part in balanced(tails, window):
                offset = 0
                for tail, start, length in part:
                    doc_id, total, raw = held[tail]
                    at = 4 * (start - tails[tail][1])
                    put(doc_id, total, start, raw[at : at + 4 * length], offset)
                    offset += length
                made += 1
            tails.clear()
            held.clear()
            waiting = 0

        for b in batches:
            ids = b.column(0).to_pylist()
            for at, n_texts in portions(b.column(1), portion):
                pa.default_memory_pool().release_unused()  # what the portion before needed
                codes, ends = enc.encode_all(b.column(1).slice(at, n_texts), end)
                for i, doc_id in enumerate(ids[at : at + n_texts]):
                    own = codes[ends[i] : ends[i + 1]]
                    n, tail = len(own), len(own) % window
                    for start in range(0, n - tail, window):
                        put(doc_id, n, start, own[start : start + window].tobytes(), 0)
                        made += 1
                        if len(rows) >= most_rows:
                            yield batch()
                    if tail:
                        tails.append((len(held), n - tail, tail))
                        held.append((doc_id, n, own[n - tail :].tobytes()))
                        waiting += tail
                    if len(tails) >= block and waiting >= FILL * window:
                        close()
                    if len(rows) >= most_rows:
                        yield batch()
        close()
        if rows:
            yield batch()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
