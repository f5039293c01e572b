"""Canonical bytes of rows, signatures over them, and tables, datasets and unit headers under authenticated encryption."""

from __future__ import annotations

import hashlib
import hmac
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from omiclake.functions.protection import opened, sealed

#: Little-endian layouts of whole and floating numbers by their Arrow type.
PRIMITIVES = {"int8": "<i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "uint8": "<u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8", "float": "<f4", "double": "<f8", "bool": "<u1"}


def _column_bytes(column: pa.Array) -> list[bytes]:
    """Each value's bytes: numbers little-endian; text and bytes after their length (u32); arrays element by element."""
    kind = str(column.type)
    if kind in PRIMITIVES:
        if column.null_count:
            raise ValueError("a number of a canonical row may not be null")
        raw = np.asarray(column.to_numpy(zero_copy_only=False)).astype(PRIMITIVES[kind])
        size = raw.itemsize
        data = raw.tobytes()
        return [data[i : i + size] for i in range(0, len(data), size)]
    if pa.types.is_list(column.type):
        kind = str(column.type.value_type)
        return [b"" if x is None else np.asarray(x, PRIMITIVES[kind]).tobytes() if kind in PRIMITIVES else b"".join(_framed(y) for y in x) for x in column.to_pylist()]
    return [_framed(x) for x in column.to_pylist()]


def _framed(value: str | bytes | None) -> bytes:
    data = b"" if value is None else value if isinstance(value, bytes) else str(value).encode()
    return struct.pack("<I", len(data)) + data


def canonical_bytes(df: DataFrame, columns: list[str], name: str = "canonical") -> DataFrame:
    """df with the bytes of each row's columns in the order given; null text has length 0, a null number raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [_column_bytes(b.column(c)) for c in columns]
            yield b.append_column(name, pa.array([b"".join(x) for x in zip(*parts, strict=True)], pa.binary()))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, BinaryType())]))


def signature(df: DataFrame, columns: list[str], order: list[str], key: bytes) -> str:
    """Hex HMAC-SHA-256 of all rows' canonical bytes in order; a partition at a time passes through the driver."""
    rows = canonical_bytes(df.select(*dict.fromkeys([*order, *columns])), columns).orderBy(*order).select("canonical")
    mac = hmac.new(key, digestmod=hashlib.sha256)
    for r in rows.toLocalIterator(prefetchPartitions=True):
        mac.update(r[0])
    return mac.hexdigest()


def is_signed(df: DataFrame, columns: list[str], order: list[str], key: bytes, expected: str) -> bool:
    return hmac.compare_digest(signature(df, columns, order, key), expected)


def verified(df: DataFrame, column: str, key: bytes, name: str = "hmac") -> DataFrame:
    """df with ok: whether the hex HMAC-SHA-256 beside a binary column is its own; a null of either isn't."""
    at, mac = df.columns.index(column), df.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(at).to_pylist(), b.column(mac).to_pylist(), strict=True)
            ok = [x is not None and y is not None and hmac.compare_digest(hmac.new(key, x, hashlib.sha256).hexdigest(), y) for x, y in pairs]
            yield b.append_column("ok", pa.array(ok, pa.bool_()))

    return df.mapInArrow(run, df.withColumn("ok", F.lit(True)).schema)


#: Fields of a unit's header and their layout, 36 bytes: all filter keys but the class, as fixed sizes.
HEADER = (("acquisition_mode", "B"), ("ms_level", "B"), ("polarity", "B"), ("retention_time", "d"), ("precursor_mz", "d"), ("precursor_charge", "B"), ("ion_mobility", "d"), ("base_peak_intensity", "d"))
_LAYOUT = struct.Struct("<" + "".join(k for _, k in HEADER))


def pack_header(values: tuple) -> bytes:
    return _LAYOUT.pack(*(x or 0 for x in values))


def unpack_header(data: bytes) -> tuple:
    return _LAYOUT.unpack(data)


def packed_headers(units: DataFrame, name: str = "header") -> DataFrame:
    """units with their header's fields as bytes; a field that units lack counts as 0."""
    at = [units.columns.index(c) if c in units.columns else -1 for c, _ in HEADER]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [b.column(i).to_pylist() if i >= 0 else [0] * b.num_rows for i in at]
            yield b.append_column(name, pa.array(list(map(pack_header, zip(*own, strict=True))), pa.binary()))

    return units.mapInArrow(run, StructType([*units.schema.fields, StructField(name, BinaryType())]))


def sealed_headers(units: DataFrame, key: Column, iv: Column, aad: Column) -> DataFrame:
    """units without their header's fields, but with the sealed header (iv, ciphertext, tag)."""
    out = packed_headers(units, "_header").withColumn("header", sealed(F.col("_header"), key, iv, aad))
    return out.drop("_header", *[c for c, _ in HEADER])


def opened_headers(units: DataFrame, key: Column, aad: Column) -> DataFrame:
    """The header's fields again; a wrong key, tag or AAD raises."""
    out = units.withColumn("_header", opened(F.col("header"), key, aad)).drop("header")
    kinds = {"B": IntegerType(), "d": DoubleType()}
    schema = StructType([f for f in out.schema.fields if f.name != "_header"])
    for c, k in HEADER:
        schema = schema.add(c, kinds[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(map(unpack_header, b.column("_header").to_pylist()))
            fields = [pa.array([r[i] for r in rows], pa.int32() if k == "B" else pa.float64()) for i, (_, k) in enumerate(HEADER)]
            kept = [c for c in b.schema.names if c != "_header"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *fields], [*kept, *(c for c, _ in HEADER)])

    return out.mapInArrow(run, schema)


def sealed_table(df: DataFrame, key: bytes, name: str) -> DataFrame:
    """A table as sealed Arrow streams: part, piece and box, each of a batch of rows, bound to the table's name and their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for piece, b in enumerate(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([piece], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "piece", "data"])

    pieces = df.mapInArrow(run, "part int, piece int, data binary")
    # The IV is drawn by the cipher itself, once for each piece.
    box = F.aes_encrypt(F.col("data"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _place(name))
    return pieces.select("part", "piece", box.alias("box"))


def _place(name: str) -> Column:
    return F.concat_ws(":", F.lit(name), F.col("part"), F.col("piece")).cast("binary")


def opened_table(boxes: DataFrame, key: bytes, name: str, schema: StructType) -> DataFrame:
    """The rows of a sealed table; a wrong key, name or place of a piece raises."""
    pieces = boxes.select(F.aes_decrypt(F.col("box"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _place(name)).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                yield from pa.ipc.open_stream(data).read_all().to_batches()

    return pieces.mapInArrow(run, schema)
