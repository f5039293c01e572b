"""What the operators share: Arrow batches of texts, the scratch folder, and text rules."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from omiclake.session import scratch, stored  # noqa: F401

#: Word separators: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of columns has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: few rows to an Arrow batch, so that a worker's memory stays bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id's decimal text, mod n. A null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n).cast("int")


def fold_of(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_text(df: DataFrame, fn: Callable[[list[bytes]], dict[str, list]], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """fn of each batch's whole texts (UTF-8; null: empty), with the columns of keep beside its results.

    schema names fn's columns and types; those of keep are taken from df.
    """
    small_batches(df.sparkSession)
    out = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = fn(raw(b.column("text")))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *map(as_array, got.values())], [*keep, *got])

    return df.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def as_array(x) -> pa.Array:
    return x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x)


def raw(texts: pa.Array) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [t or b"" for t in texts.cast(kind).to_pylist()]


class Once:
    """Made at first use in each Python worker; pickled as its recipe only."""

    def __init__(self, make: Callable, *args) -> None:
        self.make, self.args, self.value = make, args, None

    def __getstate__(self):
        return self.make, self.args

    def __setstate__(self, state) -> None:
        (self.make, self.args), self.value = state, None

    def __call__(self):
        if self.value is None:
            self.value = self.make(*self.args)
        return self.value


#: For hashes of byte windows: sums of byte times power of an odd number, mod 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers 0 to n - 1, mod 2**64."""
    b = pow(BASE, -1, 1 << 64) if inverse else BASE
    have = _powers.get(b)
    if have is None or len(have) < n:
        a = np.full(1 << max(16, (n - 1).bit_length()), b, np.uint64)
        a[0] = 1
        _powers[b] = have = np.multiply.accumulate(a)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums over the first 0 to n bytes; window_hash takes differences of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def window_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes start to end, equal for equal bytes wherever they lie."""
    return mixed((pre[end] - pre[start]) * powers(len(pre), inverse=True)[start] + (end - start).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
