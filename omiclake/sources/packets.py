"""A framed packet stream as bytes and as rows: header, payload and CRC-32C."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Header layout (24 bytes) and the reflected polynomial of CRC-32C.
HEADER = struct.Struct("<2sBBHHIIQ")
MAGIC, VERSION, CASTAGNOLI = b"OP", 1, 0x82F63B78
#: Types of packets: first, data and last.
START, UNIT, END = 1, 3, 255


def _table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (CASTAGNOLI if i & 1 else 0)
        out.append(i)
    return out


TABLE = _table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = TABLE[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def packet(kind: int, dataset_id: int, au_sequence: int, payload: bytes, checksum: bool = True) -> bytes:
    head = HEADER.pack(MAGIC, VERSION, kind, int(checksum), dataset_id, au_sequence, len(payload), 0)
    return head + payload + (struct.pack("<I", crc32c(payload)) if checksum else b"")


class Parser:
    """Takes chunks cut anywhere and gives whole packets: (kind, dataset_id, au_sequence, payload).

    The first must be a start; a dataset's sequence must grow; bytes after the end are dropped; an end is needed.
    """

    def __init__(self) -> None:
        self.rest, self.started, self.ended, self.last = b"", False, False, {}

    def feed(self, data: bytes) -> list[tuple[int, int, int, bytes]]:
        out = []
        self.rest = b"" if self.ended else self.rest + data
        while len(self.rest) >= HEADER.size and not self.ended:
            magic, version, kind, flags, dataset, seq, n, _ = HEADER.unpack_from(self.rest)
            if magic != MAGIC or version != VERSION:
                raise ValueError("not a packet")
            size = HEADER.size + n + 4 * (flags & 1)
            if len(self.rest) < size:
                break
            payload = self.rest[HEADER.size : HEADER.size + n]
            if flags & 1 and struct.unpack_from("<I", self.rest, HEADER.size + n)[0] != crc32c(payload):
                raise ValueError("checksum differs")
            if not self.started and kind != START:
                raise ValueError("the stream must begin with its header")
            if kind == UNIT:
                if seq <= self.last.get(dataset, -1):
                    raise ValueError(f"dataset {dataset}: sequence {seq} doesn't grow")
                self.last[dataset] = seq
            self.started, self.ended, self.rest = True, kind == END, self.rest[size:]
            out.append((kind, dataset, seq, payload))
        return out

    def finish(self) -> None:
        if not self.ended:
            raise ValueError("the stream has no end")


def packets(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, dataset_id, au_sequence and payload of stream files, a file to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parser = Parser()
                rows = parser.feed(data)
                parser.finish()
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "kind", "dataset_id", "au_sequence", "payload"), (p, *r), strict=True)) for r in rows], PACKETS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, kind int, dataset_id int, au_sequence bigint, payload binary")


PACKETS = pa.schema([("path", pa.string()), ("kind", pa.int32()), ("dataset_id", pa.int32()), ("au_sequence", pa.int64()), ("payload", pa.binary())])
