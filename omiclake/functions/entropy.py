"""Entropy coders and float codecs as functions of bytes and arrays, and a registry of them by number.

The byte layouts are this package's own; Parquet's encodings do this work for tables.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from omiclake.functions import codecs

#: Probabilities are of so many bits; the coder's state stays at or over LOW and gives out bytes.
SCALE, LOW = 12, 1 << 23


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE; what occurs gets 1 at least."""
    total, out = int(counts.sum()), np.zeros(len(counts), np.int64)
    if not total:
        return out
    used = np.flatnonzero(counts)
    out[used] = np.maximum(1, counts[used] * ((1 << SCALE) - len(used)) // total)
    out[used[np.argmax(counts[used])]] += (1 << SCALE) - out.sum()
    return out


def _encode(symbols: np.ndarray, table: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    """rANS from the last symbol to the first; table names the row of frequencies of each symbol."""
    state, out = LOW, bytearray()
    f, c = freq[table, symbols].tolist(), start[table, symbols].tolist()
    for i in range(len(f) - 1, -1, -1):
        n = f[i]
        most = ((LOW >> SCALE) << 8) * n
        while state >= most:
            out.append(state & 255)
            state >>= 8
        state = (state // n << SCALE) + state % n + c[i]
    return struct.pack("<I", state) + bytes(reversed(out))


def rans_encode(data: bytes, order: int = 0) -> bytes:
    """rANS of bytes by their own frequencies (order 0) or by those after the byte before (order 1)."""
    if order not in (0, 1):
        raise ValueError(f"order {order}")
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    table = np.concatenate([[0], x[:-1]]) if order and len(x) else np.zeros(len(x), np.int64)
    rows = 256 if order else 1
    counts = np.bincount(table * 256 + x, minlength=rows * 256).reshape(rows, 256)
    freq = np.stack([_frequencies(r) for r in counts])
    start = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(freq, axis=1)[:, :-1]], axis=1)
    head = zstandard.compress(freq.astype("<u2").tobytes(), 3)
    return struct.pack("<BQI", order, len(data), len(head)) + head + _encode(x, table, freq, start)


def rans_decode(packed: bytes) -> bytes:
    order, n, size = struct.unpack_from("<BQI", packed)
    rows = 256 if order else 1
    at = 13 + size
    freq = np.frombuffer(zstandard.decompress(packed[13:at]), "<u2").astype(np.int64).reshape(rows, 256)
    start = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(freq, axis=1)[:, :-1]], axis=1)
    slots = [np.repeat(np.arange(256), r).tolist() for r in freq]
    f, c, out, row, mask = freq.tolist(), start.tolist(), bytearray(n), 0, (1 << SCALE) - 1
    (state,) = struct.unpack_from("<I", packed, at)
    at += 4
    for i in range(n):
        low = state & mask
        s = slots[row][low]
        state = f[row][s] * (state >> SCALE) + low - c[row][s]
        while state < LOW and at < len(packed):
            state = state << 8 | packed[at]
            at += 1
        out[i] = s
        row = s if order else 0
    return bytes(out)


#: Values of a block of the float codec.
BLOCK = 1 << 20


def floats_encode(values: np.ndarray, block: int = BLOCK, level: int = 9) -> bytes:
    """Doubles, bit by bit as they are: of each block the smallest of four forms, with or without differences of the
    64-bit patterns, with or without the bytes of a place together; then zstd. A table of blocks comes first."""
    bits = np.ascontiguousarray(values, "<f8").view("<u8")
    parts, z = [], zstandard.ZstdCompressor(level=level)
    for i in range(0, len(bits), block):
        own = bits[i : i + block]
        forms = []
        for delta in (0, 1):
            x = np.concatenate([own[:1], own[1:] - own[:-1]]) if delta else own
            for planes in (0, 1):
                raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T) if planes else x
                forms.append((z.compress(raw.tobytes()), delta | planes << 1))
        parts.append((*min(forms, key=lambda p: len(p[0])), len(own)))
    table = b"".join(struct.pack("<IIB", len(p), n, form) for p, form, n in parts)
    return struct.pack("<QI", len(bits), len(parts)) + table + b"".join(p for p, _, _ in parts)


def floats_blocks(packed: bytes) -> list[tuple[int, int, int, int]]:
    """Place, size, number of values and form of each block, from the head alone."""
    _, n = struct.unpack_from("<QI", packed)
    out, at = [], 12 + 9 * n
    for k in range(n):
        size, many, form = struct.unpack_from("<IIB", packed, 12 + 9 * k)
        out.append((at, size, many, form))
        at += size
    return out


def floats_decode(packed: bytes, blocks: range | None = None) -> np.ndarray:
    """All values, or those of some blocks."""
    known, out = floats_blocks(packed), [np.zeros(0, "<u8")]
    for k in blocks if blocks is not None else range(len(known)):
        at, size, n, form = known[k]
        raw = np.frombuffer(zstandard.decompress(packed[at : at + size], max_output_size=8 * n), np.uint8)
        x = np.ascontiguousarray(raw.reshape(8, -1).T if form & 2 else raw).view("<u8").ravel()
        out.append(np.cumsum(x, dtype=np.uint64) if form & 1 else x)
    return np.concatenate(out).view("<f8")


def delta_encode(values: np.ndarray) -> bytes:
    """Whole numbers: differences, zigzag, varints, rANS of order 0."""
    v = np.ascontiguousarray(values, np.int64)
    d = np.concatenate([v[:1], v[1:] - v[:-1]])
    z = (d << 1) ^ (d >> 63)
    return struct.pack("<Q", len(v)) + rans_encode(codecs.varints(z.view(np.uint64))[0].tobytes())


def delta_decode(packed: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<Q", packed)
    data = np.frombuffer(rans_decode(packed[8:]), np.uint8)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if n else np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.concatenate([first, [len(data)]])))
    part = (data & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    z = np.bitwise_or.reduceat(part, first) if n else np.zeros(0, np.uint64)
    return np.cumsum((z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64))


def packed_reference(sequence: str) -> bytes:
    """A chromosome: two bits a base, other letters and runs of lower case apart, so that it comes back as it was."""
    x = np.frombuffer(sequence.encode("latin-1"), np.uint8)
    lower = (x >= 97) & (x <= 122)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], lower.astype(np.int8), [0]])))
    bases = codecs.pack_bases(np.where(lower, x - 32, x).astype(np.uint8).tobytes())
    return struct.pack("<Q", len(edge)) + codecs.varints(np.diff(edge, prepend=0))[0].tobytes() + bases + struct.pack("<Q", len(bases))


def unpacked_reference(packed: bytes) -> str:
    (n,) = struct.unpack_from("<Q", packed)
    (size,) = struct.unpack_from("<Q", packed, len(packed) - 8)
    x = np.frombuffer(codecs.unpack_bases(packed[len(packed) - 8 - size : len(packed) - 8]), np.uint8).copy()
    at, edge, place = 8, [], 0
    for _ in range(n):
        gap, at = codecs.read_varint(packed, at)
        place += gap
        edge.append(place)
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        x[a:b] += 32
    return x.tobytes().decode("latin-1")


@dataclass(frozen=True)
class Codec:
    """A named pair of functions of bytes; context tells that a decoder needs more than the bytes."""

    number: int
    name: str
    encode: Callable[[bytes], bytes]
    decode: Callable[[bytes], bytes]
    context: bool = False


def _doubles(f: Callable, back: bool) -> Callable[[bytes], bytes]:
    return (lambda b: f(b).tobytes()) if back else (lambda b: f(np.frombuffer(b, "<f8")))


def _longs(f: Callable, back: bool) -> Callable[[bytes], bytes]:
    return (lambda b: f(b).astype("<i8").tobytes()) if back else (lambda b: f(np.frombuffer(b, "<i8")))


CODECS: dict[int, Codec] = {
    c.number: c
    for c in (
        Codec(0, "none", bytes, bytes),
        Codec(1, "zstd", lambda b: zstandard.compress(b, 9), zstandard.decompress),
        Codec(4, "rans_order_0", rans_encode, rans_decode),
        Codec(5, "rans_order_1", lambda b: rans_encode(b, 1), rans_decode),
        Codec(6, "base_pack", codecs.pack_bases, codecs.unpack_bases),
        Codec(7, "quality_binned", codecs.pack_qualities, codecs.unpack_qualities),
        Codec(11, "delta_rans", _longs(delta_encode, False), _longs(delta_decode, True)),
        Codec(17, "float_delta_zstd", _doubles(floats_encode, False), _doubles(floats_decode, True)),
    )
}


def coded(df: DataFrame, column: str, number: int, decode: bool = False) -> DataFrame:
    """df with a binary column run through a codec in Arrow batches; nulls stay null, an unknown number raises."""
    codec = CODECS[number]
    f, at = codec.decode if decode else codec.encode, df.columns.index(column)

    def run(batches):
        for b in batches:
            out = pa.array([None if x is None else f(x) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([out if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return df.mapInArrow(run, StructType([StructField(x.name, BinaryType() if x.name == column else x.dataType) for x in df.schema]))
