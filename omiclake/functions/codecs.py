"""Value-level codecs: what their decoders give, not the bytes of foreign files."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds of the quality bins and what their members become.
QUALITY_BINS = ((0, 0), (2, 5), (10, 15), (20, 22), (25, 27), (30, 32), (35, 37), (40, 40))


def binned_quality(q: Column) -> Column:
    out = F.lit(QUALITY_BINS[0][1])
    for low, value in QUALITY_BINS[1:]:
        out = F.when(q >= low, F.lit(value)).otherwise(out)
    return out


def points_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The code points of each text; a null one has none."""
    for t in texts:
        yield np.frombuffer((t.as_py() or "").encode("utf-32-le"), np.uint32)


def code_points(text: Column) -> Column:
    """The code points of a text, an array of ints."""

    @F.arrow_udf("array<int>")
    def points(texts: pa.Array) -> pa.Array:
        return pa.array([x.astype(np.int32) for x in points_of(texts)], pa.list_(pa.int32()))

    return points(text)


def letters(text: Column, alphabet: str) -> Column:
    """A text of as many characters: each that of the ASCII alphabet at its code point, modulo the alphabet's size."""

    @F.arrow_udf("string")
    def drawn(texts: pa.Array) -> pa.Array:
        table = np.frombuffer(alphabet.encode("ascii"), np.uint8)
        return pa.array([table[x % len(alphabet)].tobytes() for x in points_of(texts)], pa.binary()).cast(pa.string())

    return drawn(text)


def pack_qualities(data: bytes) -> bytes:
    """Bin numbers, two to a byte, low half first, after the count as 8 bytes."""
    at = np.searchsorted([low for low, _ in QUALITY_BINS], np.frombuffer(data, np.uint8), side="right") - 1
    at = np.append(at, 0)[: len(at) + len(at) % 2].astype(np.uint8)
    return len(data).to_bytes(8, "little") + (at[::2] | at[1::2] << 4).tobytes()


def unpack_qualities(packed: bytes) -> bytes:
    n, half = int.from_bytes(packed[:8], "little"), np.frombuffer(packed, np.uint8, offset=8)
    at = np.stack([half & 15, half >> 4], axis=1).ravel()[:n]
    return np.array([v for _, v in QUALITY_BINS], np.uint8)[at].tobytes()


def binning_allowed(platform: Column) -> Column:
    """Not for long-read platforms, whose qualities aren't of these bins."""
    p = F.lower(F.coalesce(platform, F.lit("")))
    return ~p.rlike(r"hifi|pacbio|nanopore|(^|[^a-z0-9])ont([^a-z0-9]|$)")


def numpress_scale(low: float, high: float) -> int:
    """The largest scale that keeps 62 bits for the range."""
    most = max(abs(low), abs(high))
    return 1 if most == 0 or math.isinf(most) else max(1, int((2**62 - 1) / most))


def numpress_deltas(values: Column, scale: float) -> Column:
    """First differences of rint(x scale); the first value stands for itself."""
    fixed = F.transform(values, lambda x: F.rint(x * scale).cast("long"))
    return F.transform(fixed, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(fixed, i - 1)))


def numpress_values(deltas: Column, scale: float) -> Column:
    """Running sums over scale, row by row in Arrow batches; a null array stays null."""

    @F.pandas_udf("array<double>")
    def values(rows: pd.Series) -> pd.Series:
        return rows.map(lambda d: None if d is None else np.cumsum(np.asarray(d, np.int64)) / float(scale))

    return values(deltas)


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1).cast("long"))))


def varint(n: int) -> bytes:
    """LEB128 of a non-negative number."""
    if n < 0:
        raise ValueError("negative")
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number at a place and the place after it."""
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("varint is cut short or too long")
        n, shift, at = n | (data[at] & 127) << shift, shift + 7, at + 1
        if data[at - 1] < 128:
            return n, at


def varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LEB128 of many non-negative numbers: all bytes, and the size of each."""
    n = numbers.astype(np.uint64)
    size = np.maximum(1, -(-np.frexp(n.astype(np.float64))[1] // 7))
    size += (n >> (7 * size).astype(np.uint64) != 0) & (size < 10)  # a float may round to a lower or higher power
    last = np.cumsum(size)
    owner = np.repeat(np.arange(len(n)), size)
    place = np.arange(last[-1] if len(n) else 0) - np.repeat(last - size, size)
    low = (n[owner] >> (7 * place).astype(np.uint64) & np.uint64(127)).astype(np.uint8)
    return low | np.where(place + 1 < size[owner], 128, 0).astype(np.uint8), size


def pack_bases(data: bytes) -> bytes:
    """Two bits for each of A, C, G, T; other bytes as (gap, byte) pairs. Any bytes come back as they were."""
    x = np.frombuffer(data, np.uint8)
    code = np.full(256, 255, np.uint8)
    code[list(b"ACGT")] = range(4)
    bits = code[x]
    odd = np.flatnonzero(bits == 255)
    bits = np.append(np.where(bits == 255, 0, bits), np.zeros(-len(x) % 4, np.uint8)).reshape(-1, 4).astype(np.uint8)
    packed = (bits[:, 0] | bits[:, 1] << 2 | bits[:, 2] << 4 | bits[:, 3] << 6).tobytes()
    gaps, size = varints(np.diff(odd, prepend=0))
    after = np.cumsum(size)
    return varint(len(data)) + varint(len(odd)) + np.insert(gaps, after, x[odd]).tobytes() + packed


def unpack_bases(packed: bytes) -> bytes:
    n, at = read_varint(packed)
    m, at = read_varint(packed, at)
    quads = (n + 3) // 4
    listed = np.frombuffer(packed, np.uint8, len(packed) - quads - at, at)
    quad = np.frombuffer(packed, np.uint8, quads, len(packed) - quads)
    out = np.frombuffer(b"ACGT", np.uint8)[np.stack([quad >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel()[:n]].copy()
    if m:
        place, value = exceptions(listed, m)
        out[place] = value
    return out.tobytes()


def exceptions(listed: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and bytes of m (gap, byte) pairs, where a gap is a varint and the byte may be any.

    A gap under 128 takes a pair of bytes; runs of such pairs are read together.
    """
    gaps, value, at, have = [], [], 0, 0
    while have < m:
        pairs = listed[at : at + 2 * (m - have)]
        low = pairs[: len(pairs) // 2 * 2].reshape(-1, 2)
        long = np.flatnonzero(low[:, 0] > 127)
        k = int(long[0]) if len(long) else len(low)
        gaps.append(low[:k, 0].astype(np.int64))
        value.append(low[:k, 1])
        at, have = at + 2 * k, have + k
        if have < m:
            gap, at = read_varint(listed[at : at + 11].tobytes(), 0)[0], at + read_varint(listed[at : at + 11].tobytes(), 0)[1]
            gaps.append(np.array([gap], np.int64))
            value.append(listed[at : at + 1])
            at, have = at + 1, have + 1
    return np.cumsum(np.concatenate(gaps)), np.concatenate(value)


def phred_offset(qualities: Column) -> Column:
    """33 where any byte is under 59; 64 where all lie in 64 to 104; else 33. qualities: an array of byte values."""
    low, high = F.array_min(qualities), F.array_max(qualities)
    return F.when(low < 59, 33).when((low >= 64) & (high <= 104), 64).otherwise(33)
