"""Operator 7: token ids in files of directly addressable codes, written and read back.

An id is cut into 8-bit chunks, the lowest on level 0. Each level has its chunks, a bitmap of which of them go on
to the next level, and a rank directory (the number of ones before each 512 bits), so the id at any
position is found by one rank for each level, without decoding others. The files are Parquet: a row is a
segment of consecutive documents (range partitions in ascending doc_id order, so the part and segment
numbers give the order of all ids), with the ids as one block of codes.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omiclake.llm.bpe import LATIN, byte_characters
from omiclake.llm.common import Once, documents, raw, scratch, small_batches

END_ID = 2
#: Bits of a bitmap between two entries of its rank directory.
STRIDE = 512
#: Remembered pieces of a worker: when there are so many they grow old, and those that grew old before are forgotten.
REMEMBERED = 350_000
SEGMENT = "part int, segment int, first_token bigint, n_tokens bigint, doc_ids binary, null_ids binary, lengths binary, codes binary"


def pack(ids: np.ndarray) -> bytes:
    """Codes of non-negative ids under 2**32: the number of ids and levels, then each level."""
    out, rest, levels = [], ids.astype(np.uint32), 0
    while levels == 0 or len(rest):
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little").tobytes()
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, max(1, len(more)), STRIDE), dtype=np.uint32))[:-1]]) if len(more) else np.zeros(0)
        out += [struct.pack("<Q", len(rest)), (rest & np.uint32(255)).astype(np.uint8).tobytes(), bitmap, ones.astype("<u4").tobytes()]
        rest = rest[more] >> np.uint32(8)
        levels += 1
    return struct.pack("<B", levels) + b"".join(out)


def levels(codes: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap and rank directory of each level; views, nothing is decoded."""
    at, out = 1, []
    for _ in range(codes[0]):
        (n,) = struct.unpack_from("<Q", codes, at)
        at += 8
        parts = []
        for size, kind in ((n, "u1"), ((n + 7) // 8, "u1"), ((n + STRIDE - 1) // STRIDE, "<u4")):
            parts.append(np.frombuffer(codes, kind, size, at))
            at += size * np.dtype(kind).itemsize
        out.append(tuple(parts))
    return out


def unpack(codes: bytes) -> np.ndarray:
    """All ids, level by level from the highest."""
    ids = None
    for chunks, bitmap, _ in reversed(levels(codes)):
        low = chunks.astype(np.uint32)
        if ids is not None and len(ids):
            at = np.flatnonzero(np.unpackbits(bitmap, count=len(chunks), bitorder="little"))
            low[at] |= ids << np.uint32(8)
        ids = low
    return ids


def token_at(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], i: int) -> int:
    """The id at position i of a block's levels."""
    out = 0
    for k, (chunks, bitmap, ones) in enumerate(parts):
        out |= int(chunks[i]) << (8 * k)
        if not bitmap[i >> 3] >> (i & 7) & 1:
            break
        block = i // STRIDE
        before = np.unpackbits(bitmap[block * STRIDE // 8 : (i >> 3) + 1], bitorder="little")[: i - block * STRIDE]
        i = int(ones[block]) + int(before.sum())
    return out


def _characters(kind: str) -> str:
    """The characters below LATIN whose category begins with this letter, escaped for a character class."""
    return "".join(re.escape(chr(c)) for c in range(ord(LATIN)) if unicodedata.category(chr(c))[0] == kind)


def below_latin() -> re.Pattern:
    """The byte-level pattern in the standard library's terms; equal to it on texts of characters below LATIN."""
    letters, numbers, space = _characters("L"), _characters("N"), " \t\n\x0b\x0c\r\x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


class Tokenizer:
    """The tokenizers library over one file. A text is cut where no pre-token can reach over, its pieces are remembered.

    literal: strings of special tokens in a text are ordinary text; by default they give their ids, as in the library.
    """

    def __init__(self, path: str, literal: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        self.whole.encode_special_tokens = literal
        self.special = [] if literal else [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.split = self.whole.pre_tokenizer.pre_tokenize_str
        self.tokenize = self.whole.model.tokenize
        self.cuttable = self._cuttable()
        self.odd = re.compile(r" \s")
        self.find = below_latin().findall
        self.beyond = re.compile(f"[^\x00-{chr(ord(LATIN) - 1)}]").search
        self.mapped = "".join(byte_characters())
        self.known: dict[str, bytes] = {}  # what follows a space
        self.pieces: dict[str, bytes] = {}
        self._grow_old()

    def _grow_old(self) -> None:
        self.old, self.known, self.pieces = self.known, {"": self._ids("Ġ")} if self.cuttable else {}, {}

    def _cuttable(self) -> bool:
        """Only a byte-level pre-tokenizer with the usual pattern is known to cut at a space before a word."""
        kind = type(self.whole.pre_tokenizer).__name__
        return kind == "ByteLevel" and self.whole.normalizer is None and self.split("a b") == [("a", (0, 1)), ("Ġb", (1, 3))]

    def _ids(self, mapped: str) -> bytes:
        ids = [t.id for t in self.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _found(self, pieces: list[str]) -> list[bytes]:
        """The ids of pre-tokens; one that begins with a space is known by what follows it."""
        known, others = self.known, self.pieces
        out = [known.get(p[1:]) if p[0] == " " else others.get(p) for p in pieces]
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    p = pieces[i]
                    out[i] = ids = self._ids(p.encode().decode("latin-1").translate(self.mapped))
                    if p[0] == " ":
                        known[p[1:]] = ids
                    else:
                        others[p] = ids
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Remembers what follows spaces, all at once: each chunk's first pre-token, and no other, begins with a space."""
        pieces = self.find(" " + " ".join(chunks))
        ids = self._found(pieces)
        start = [i for i, p in enumerate(pieces) if p[0] == " "]
        for c, i, j in zip(chunks, start, [*start[1:], len(pieces)], strict=True):
            if j > i + 1:
                self.known[c] = b"".join(ids[i:j])

    def _library(self, chunk: str) -> bytes:
        """Beyond Latin the library's own pre-tokenizer decides."""
        return b"".join([self._ids(w) for w, _ in self.split(chunk)])

    def encode(self, text: str) -> bytes:
        """The whole text's ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        # A space between two white-space characters may lie within a pre-token; special tokens may lie anywhere.
        if not self.cuttable or self.odd.search(text) or any(t in text for t in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) > REMEMBERED:
            self._grow_old()
        known, cut = self.known, text.split(" ")
        out = list(map(known.get, cut))
        simple = text.isascii() or not self.beyond(text)
        out[0] = (b"".join(self._found(self.find(cut[0]))) if simple or not self.beyond(cut[0]) else self._library(cut[0])) if cut[0] else b""
        if None in out:
            new = list({c for c, ids in zip(cut, out, strict=True) if ids is None})
            known |= {c: ids for c, ids in zip(new, map(self.old.get, new), strict=True) if ids is not None}
            if not simple:
                known |= {c: self._library(" " + c) for c in filter(self.beyond, new) if c not in known}
            new = [c for c in new if c not in known]
            if new:
                self._learn(new)
            out = [known[c] if ids is None else ids for c, ids in zip(cut, out, strict=True)]
        return b"".join(out)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, tokens: int = 1 << 20, partitions: int | None = None) -> None:
    """Writes the ids of all whole texts (null: empty), each followed by end_id, in ascending doc_id order.

    Null ids come first; rows of one id go by their text. tokens: of a segment, about. An empty table
    writes no segment.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or max(12, 2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    coder = Once(Tokenizer, tokenizer)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part = coder(), TaskContext.get().partitionId()
        ids: list[int | None] = []
        blocks: list[bytes] = []
        size = segment = first = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in blocks], "<u4")
            total = int(lengths.sum())
            row = [part, segment, first, total, np.array([i or 0 for i in ids], "<i8").tobytes(), np.packbits([i is None for i in ids]).tobytes(), lengths.tobytes(), pack(np.frombuffer(b"".join(blocks), "<u4"))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 4
            names = ["part", "segment", "first_token", "n_tokens", "doc_ids", "null_ids", "lengths", "codes"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), raw(b.column("text")), strict=True):
                ids.append(i)
                blocks.append(c.encode(t.decode()) + end)
                size += len(blocks[-1]) // 4
                if size >= tokens:
                    yield flush()
                    first, segment, size, ids, blocks = first + size, segment + 1, 0, [], []
        if blocks:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, SEGMENT).write.parquet(path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part and part_start: the ids before each part. Parts are as many as tasks wrote; their totals fit the driver."""
    total, out = 0, []
    for part, n in sorted(map(tuple, spark.read.schema(SEGMENT).parquet(path).groupBy("part").agg(F.sum("n_tokens")).collect())):
        out.append((part, total))
        total += n
    return spark.createDataFrame(out, "part int, part_start bigint")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids: of each document, from the files alone."""
    starts = F.broadcast(part_starts(spark, path))
    rows = spark.read.schema(SEGMENT).parquet(path).join(starts, "part")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                get = lambda k: b.column(k)[r].as_py()  # noqa: B023, E731
                length = np.frombuffer(get("lengths"), "<u4").astype(np.int64)
                doc = np.frombuffer(get("doc_ids"), "<i8")
                null = np.unpackbits(np.frombuffer(get("null_ids"), np.uint8), count=len(doc)).astype(bool)
                ids = unpack(get("codes")).astype("<u4")
                end = np.cumsum(length)
                data = memoryview(ids.tobytes())
                cut = [data[4 * i : 4 * j] for i, j in zip((end - length).tolist(), end.tolist(), strict=True)]
                out = [pa.array(doc, mask=null), pa.array(end - length + get("part_start") + get("first_token")), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                if with_ids:
                    out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in cut], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return rows.select("part_start", "first_token", "doc_ids", "null_ids", "lengths", "codes").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def read_at(spark: SparkSession, path: str, positions: list[int]) -> dict[int, int]:
    """The ids at the given positions of all ids: only the segments that hold them are read."""
    starts = F.broadcast(part_starts(spark, path))
    rows = spark.read.schema(SEGMENT).parquet(path).join(starts, "part").withColumn("at", F.col("part_start") + F.col("first_token"))
    asked = F.broadcast(spark.createDataFrame([(int(p),) for p in positions], "position bigint"))
    found = rows.join(asked, (asked["position"] >= rows["at"]) & (asked["position"] < rows["at"] + rows["n_tokens"]))
    return {r["position"]: token_at(levels(bytes(r["codes"])), r["position"] - r["at"]) for r in found.select("position", "at", "codes").toLocalIterator()}


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
