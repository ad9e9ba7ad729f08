"""Token ids of whole texts, and a Parquet store of token lists.

The store keeps one row per document in ascending document order: the ids as a LIST column with
DELTA_BINARY_PACKED encoding, the per-document metadata as dictionary or delta encoded columns in
the same row groups, bounded row groups, and page indexes with bounded pages. So a metadata read touches no ids, and a read of a few documents
touches only the pages whose index admits them.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import partitions, text_or_empty

#: Pieces of a text: a run of white space with what follows it, cut again between a letter or digit
#: and one of PUNCT. No token of a GPT-2 style pre-tokenizer reaches over the start of a piece, so
#: the ids of a text are those of its pieces in a row.
PUNCT = r"""[.,!?;:*$%&#|<>()"]"""
PIECE = re.compile(rf"""\s*[^\s.,!?;:*$%&#|<>()"]+(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ])(?={PUNCT})|{PUNCT}\S*|\s*\S+|\s+""")
BETWEEN = re.compile(r"\S (?=\S)")
#: A space that ends the text or has white space after it; before any other space a text can be cut too.
LOOSE = re.compile(r" (?=\s|\Z)")
#: The same for Arrow's regexes, together with the characters below.
ODD = r" (?:[\t-\r \x{85}\p{Z}]|\z)|[\x{1c}-\x{1f}\x{85}\x{180e}\x{200b}\x{feff}]"
#: Characters that Python and the tokenizer's regex class differently as white space.
UNSURE = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: One piece that is certainly one pre-token and whose byte-level spelling is known.
PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
CACHE_WORDS, CACHE_PIECES, CACHE_LEN = 450_000, 40_000, 48
#: Texts, and bytes of text, that are encoded together; characters of a text that are encoded at once.
AT_ONCE, BYTES_AT_ONCE, LONG = 2048, 8 << 20, 1 << 20


def _spelling() -> dict[int, str]:
    """Byte-level BPE writes each byte as a character: printable ones as themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


SPELLING = _spelling()


class _Pieces(dict):
    """Little-endian ids of pieces. Two generations of at most so many short pieces are kept."""

    def __init__(self, tokenizer, most: int = CACHE_PIECES) -> None:
        super().__init__()
        self.tokenizer, self.model, self.old, self.most = tokenizer, tokenizer.model, {}, most

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self.ids(piece)
        if len(piece) <= CACHE_LEN:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out

    def ids(self, piece: str) -> bytes:
        if PLAIN.fullmatch(piece):
            return self.letters(piece)
        return packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def letters(self, piece: str) -> bytes:
        """Of one pre-token: the model's own encoding of its byte-level spelling."""
        return packed([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(SPELLING))])


class _Words(_Pieces):
    """Ids of a space with the characters up to the next one, keyed without that space; made of pieces."""

    def __init__(self, tokenizer, most: int) -> None:
        super().__init__(tokenizer, most)
        self.pieces = _Pieces(tokenizer)
        self.marks = {c: self.pieces[c] for c in ".,!?;:"}
        self.newline = self.pieces["\n"]

    def __missing__(self, word: str) -> bytes:
        mark = self.marks.get(word[-1:])
        if mark is not None and word[:-1].isalpha():
            return self[word[:-1]] + mark  # not kept: the word is
        if "\n" in word:
            left, _, right = word.partition("\n")
            if left and right and not left[-1].isspace() and not right[0].isspace():
                # A line's end and the next one's start: one newline between words is a token of its own.
                return self[left] + self.newline + b"".join(map(self.pieces.__getitem__, PIECE.findall(right)))
        out = self.old.get(word)
        if out is None:
            if word.isalpha() and word.isascii():
                out = packed([t.id for t in self.model.tokenize("Ġ" + word)])
            elif word.isalpha() and max(word) < "\u0250":
                out = self.letters(" " + word)
            else:
                out = b"".join(map(self.pieces.__getitem__, PIECE.findall(" " + word)))
        if len(word) <= CACHE_LEN:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Encodes whole texts with the tokenizers library.

    Where the tokenizer's file says that pieces are independent (byte-level pre-tokenizer with its
    regex, no prefix space, no normalizer), each distinct piece is encoded once and remembered;
    otherwise each text is encoded in one call. Both give the same ids.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        #: Literals that the library finds in texts; a text with one is encoded in one call, without the switch.
        self.literals = [t["content"] for t in spec.get("added_tokens") or ()]
        pre = spec.get("pre_tokenizer") or {}
        free = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.words = _Words(self.tokenizer, cache_words) if free and not spec.get("truncation") and not spec.get("padding") else None

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, 4 bytes each."""
        if self.words is None or any(x in text for x in self.literals):
            self.tokenizer.encode_special_tokens = False
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            self.tokenizer.encode_special_tokens = True
            return packed(ids)
        if UNSURE.search(text):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(text) > LONG:
            # Cut before single spaces between words, where no token reaches over.
            out, at = [], 0
            while len(text) - at > LONG and (cut := BETWEEN.search(text, at + LONG)):
                out.append(self._pieces(text[at : cut.start() + 1]))
                at = cut.start() + 1
            return b"".join(out) + self._pieces(text[at:])
        return self._pieces(text)

    def _pieces(self, text: str) -> bytes:
        if LOOSE.search(text):
            return b"".join(map(self.words.pieces.__getitem__, PIECE.findall(text)))
        first, *rest = text.split(" ")
        lead = b"".join(map(self.words.pieces.__getitem__, PIECE.findall(first)))
        return lead + b"".join(map(self.words.__getitem__, rest))


    def encode_all(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and the offsets of the texts in them.

        Arrow cuts the texts at spaces and numbers the distinct words; each of these is looked up
        once, and its ids are put in place wherever it occurs.
        """
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_string())
        n = len(texts)
        odd = pc.greater(pc.binary_length(texts), LONG).to_numpy(zero_copy_only=False)
        if self.words is None:
            odd[:] = True
        else:
            odd = odd | pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
            for literal in self.literals:
                odd = odd | pc.match_substring(texts, literal).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
        cut = pc.split_pattern(plain, " ")
        offsets = cut.offsets.to_numpy()
        offsets = offsets - offsets[0]
        words = cut.flatten().dictionary_encode()
        at = words.indices.to_numpy().astype(np.int64)
        known = list(map(self.words.__getitem__, words.dictionary.to_pylist())) if self.words is not None else [b""] * len(words.dictionary)
        # The first word of a text has no space before it; a text with odd spaces is one word of its own.
        firsts = words.take(pa.array(offsets[:-1])).dictionary_decode().to_pylist()
        for i in range(n):
            known.append(self.encode(texts[i].as_py() if odd[i] else firsts[i]))
        at[offsets[:-1]] = len(words.dictionary) + np.arange(n)
        known.append(end)
        at = np.insert(at, offsets[1:], len(known) - 1)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.concatenate([[0], np.cumsum(size)])
        lists = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(known), np.int32)))
        ids = lists.take(pa.array(at)).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[at])])[offsets + np.arange(n + 1)]
        return ids, ends


def portions(texts: pa.Array, most_bytes: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """(start, count) of runs of texts that are encoded together: larger ones repeat more words and cost less, and take more memory."""
    import pyarrow.compute as pc

    sizes, start, held = pc.binary_length(texts).to_numpy(zero_copy_only=False), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (held + n > most_bytes or i - start >= AT_ONCE):
            yield start, i - start
            start, held = i, 0
        held += n
    if len(sizes):
        yield start, len(sizes) - start


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One encoder per Python worker and file; it remembers up to twice cache_words words."""
    if (path, cache_words) not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path, cache_words] = Encoder(path, cache_words)
    return _encoders[path, cache_words]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shard, local_start, n_tokens, ids) in the row order of each partition.

    shard is the partition's number and local_start counts the ids before the document in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), packed([end_id])
        shard, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, n in portions(batch.column(1)):
                part = batch.slice(at, n)
                ids, ends = enc.encode_all(part.column(1), end)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(part.num_rows, shard, np.int32)), pa.array(before + ends[:-1]), pa.array(np.diff(ends)), lists],
                    ["doc_id", "shard", "local_start", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, shard int, local_start long, n_tokens long, ids array<int>")


class TokenStore:
    """Token lists of documents in Parquet files, in ascending doc_id order (null first).

    Rows that share a doc_id are kept, next to each other. A null text is an empty one. Extra
    columns of the input are not stored.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @staticmethod
    def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, *, row_group_mb: int = 16, page_kb: int = 64, page_rows: int = 500, files: int | None = None) -> TokenStore:
        """Range-partition the texts by doc_id (the one shuffle), encode, and write one file per range."""
        spark = docs.sparkSession
        ordered = docs.select("doc_id", "text").repartitionByRange(files or partitions(spark), "doc_id").sortWithinPartitions("doc_id")
        (
            encoded(ordered, tokenizer, end_id)
            .write.option("parquet.block.size", row_group_mb << 20)
            .option("parquet.page.size", page_kb << 10)
            .option("parquet.page.row.count.limit", page_rows)
            .option("parquet.writer.version", "PARQUET_2_0")
            .option("parquet.enable.dictionary#ids.list.element", "false")
            .option("compression", "snappy")
            .parquet(path)
        )
        return TokenStore(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, shard int, local_start long, n_tokens long, ids array<int>").parquet(self.path)

    def bases(self) -> DataFrame:
        """(shard, base): ids in all shards before. One row per file, so small enough to broadcast."""
        from pyspark.sql import Window

        sums = self.rows().groupBy("shard").agg(F.sum("n_tokens").alias("n"))
        return sums.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))

    def metadata(self) -> DataFrame:
        """(doc_id, start, n_tokens); reads no ids."""
        return self.rows().select("doc_id", "shard", "local_start", "n_tokens").join(F.broadcast(self.bases()), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens")

    def tokens(self, doc_ids: list[int] | None = None) -> DataFrame:
        """(doc_id, ids), of the given documents only: the filter reaches the row groups and page indexes."""
        rows = self.rows() if doc_ids is None else self.rows().filter(F.col("doc_id").isin(list(doc_ids)))
        return rows.select("doc_id", "ids")

    def digest(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32), each from the files."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(3)
                ends, data = lists.offsets.to_pylist(), memoryview(lists.values.buffers()[1] or b"").cast("B")
                at = lists.values.offset
                crc = [zlib.crc32(data[4 * (at + a) : 4 * (at + b)]) for a, b in zip(ends[:-1], ends[1:])]
                n = [b - a for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"])

        read = self.rows().select("doc_id", "shard", "local_start", "ids").mapInArrow(run, "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long")
        return read.join(F.broadcast(self.bases()), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
