"""Two-dimensional correlation, quantiles and other numeric analyses."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frequencies of all columns that a task multiplies at once.
FREQUENCIES = 4096


def hilbert_noda(spark: SparkSession, m: int) -> DataFrame:
    """j, k and value: 0 on the diagonal, else 1 / (pi (k - j)). m x m rows are the result itself."""
    at = spark.range(m).select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("k"), F.col("id").cast("int").alias("j"))
    return at.select("j", "k", F.when(F.col("j") == F.col("k"), 0.0).otherwise(1 / (math.pi * (F.col("k") - F.col("j")))).alias("value"))


def correlation_2d(spectra: DataFrame, group: str, order: str, values: str = "intensity", reference: list[float] | None = None) -> DataFrame:
    """group, i, j, synchronous and asynchronous of the dynamic spectra of each group, taken in the given order.

    Deviations D from the mean (or a reference) give D'D / (m - 1) and D'ND / (m - 1), m rows of n values. N depends on k - j
    only: it's a convolution, so that both are sums over the frequencies of D's columns. A task holds one column of a group, or
    FREQUENCIES of all; no m x m matrix is made. Groups of under two spectra, or of unequal lengths, raise.
    """
    kind = spectra.schema[group].dataType.simpleString()
    key = spectra.schema[order].dataType.simpleString()
    rows = spectra.select(F.col(group).alias("group"), F.col(order).alias("at"), F.col(values).cast("array<double>").alias("x"))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows as runs of a group's columns; a run has the place of its first row, and its number in the task."""
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            g, size = b.column(0).to_pylist(), pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy()
            new = [i for i in range(len(g)) if not i or g[i] != g[i - 1]]
            for low, high in zip(new, [*new[1:], len(g)], strict=True):
                wide = int(size[low])
                if (size[low:high] != wide).any() or not wide:
                    raise ValueError("two spectra of equal length or more are needed")
                part = b.slice(low, high - low)
                x = np.ascontiguousarray(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, wide).T)
                same = [part.column(i).take(pa.array(np.zeros(wide, np.int64))) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(wide, n)), pa.array(np.arange(wide, dtype=np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["group", "at", "run", "i", "x"])
                n += 1

    def frequencies(t: pa.Table) -> pa.Table:
        """A column's deviations as parts of their spectrum, padded so that ends don't meet."""
        t = t.sort_by([("at", "ascending"), ("run", "ascending")])
        i = t["i"][0].as_py()
        x = np.concatenate([np.frombuffer(v.as_buffer(), float) for v in t["x"]])
        m = len(x)
        if m < 2 or reference is not None and len(reference) <= i:
            raise ValueError("two spectra of equal length or more are needed")
        f = np.fft.rfft(x - (x.mean() if reference is None else reference[i]), padded(m))
        parts = [f[k : k + FREQUENCIES].tobytes() for k in range(0, len(f), FREQUENCIES)]
        same = [pa.array([v] * len(parts), ty) for v, ty in ((t["group"][0].as_py(), t.schema.field("group").type), (i, pa.int32()), (m, pa.int64()))]
        return pa.table([*same, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["group", "i", "m", "part", "f"])

    def products(t: pa.Table) -> pa.Table:
        """What a part of the frequencies adds to each row of both matrices."""
        t = t.sort_by("i")
        m, part, n = t["m"][0].as_py(), t["part"][0].as_py(), t.num_rows
        if pc.count_distinct(t["m"]).as_py() > 1 or reference is not None and len(reference) != n:
            raise ValueError("two spectra of equal length or more are needed")
        f = np.stack([np.frombuffer(v.as_buffer(), complex) for v in t["f"]])
        at, size = part * FREQUENCIES + np.arange(f.shape[1]), padded(m)
        # A real signal's spectrum has each frequency twice, but for the first and, of even sizes, the last.
        weight = np.where((at == 0) | (2 * at == size), 1.0, 2.0) / size / (m - 1)
        s, p = (f.conj() * weight) @ f.T, (f.conj() * (weight * noda_spectrum(m)[at])) @ f.T
        cells = [pa.array([np.ascontiguousarray(r).tobytes() for r in y.real], pa.binary()) for y in (s, p)]
        return pa.table([t["group"], t["i"], *cells], ["group", "i", "s", "p"])

    def total(t: pa.Table) -> pa.Table:
        """The sums of a row, one output row for each of its cells."""
        s, p = (np.sum([np.frombuffer(v.as_buffer(), float) for v in t[c]], axis=0) for c in ("s", "p"))
        same = [pa.array([t[c][0].as_py()] * len(s), t.schema.field(c).type) for c in ("group", "i")]
        return pa.table([*same, pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s), pa.array(p)], [group, "i", "j", "synchronous", "asynchronous"])

    runs = rows.orderBy("group", F.asc_nulls_last("at")).mapInArrow(columns, f"group {kind}, at {key}, run bigint, i int, x binary")
    spectrum = runs.groupBy("group", "i").applyInArrow(frequencies, f"group {kind}, i int, m bigint, part int, f binary")
    rows = spectrum.groupBy("group", "part").applyInArrow(products, f"group {kind}, i int, s binary, p binary")
    return rows.groupBy("group", "i").applyInArrow(total, f"{group} {kind}, i int, j int, synchronous double, asynchronous double")


def padded(m: int) -> int:
    """The least size of small factors that holds m values and their shifts by less than m."""
    return min(odd << max(0, -(-(2 * m - 1) // odd) - 1).bit_length() for odd in (1, 3, 5, 9, 15))


def noda_spectrum(m: int) -> np.ndarray:
    """The Hilbert-Noda matrix as a convolution, by frequency."""
    size, k = padded(m), np.arange(1, m)
    g = np.zeros(size)
    g[k], g[size - k] = -1 / (np.pi * k), 1 / (np.pi * k)
    return np.fft.rfft(g)


def disrelation(synchronous: Column, asynchronous: Column) -> Column:
    """|S| / (|S| + |A|); NaN where both are 0."""
    total = F.abs(synchronous) + F.abs(asynchronous)
    return F.when(total > 0, F.abs(synchronous) / total).otherwise(F.lit(float("nan")))


def quantile(values: Column, q: float) -> Column:
    """Linear interpolation between the sorted values at q (n - 1); null of an empty array."""
    s = F.array_sort(values)
    at = F.lit(q) * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.coalesce(F.get(s, low + 1), F.get(s, low))
    return F.when(F.size(values) > 0, a + (b - a) * (at - low))


def mask_below_quantile(values: Column, q: float) -> Column:
    """Values strictly under the spectrum's own quantile become 0.0."""
    cut = F.array(quantile(values, q))  # one element, so that the sort is done once for a row and not for each value
    masked = F.transform(cut, lambda c: F.transform(values, lambda x: F.when(x < c, F.lit(0.0)).otherwise(x)))
    return F.get(masked, F.lit(0))


def coarsen(x: Column, decimals: int) -> Column:
    """rint(x 10^d) / 10^d: half goes to even, as numpy rounds."""
    return F.rint(x * F.lit(10.0**decimals)) / F.lit(10.0**decimals)


def frames_summary(frames: DataFrame) -> DataFrame:
    """One row of an acquisition's frames: counts by MS type and the range of times, 0 of none."""
    return frames.agg(
        F.count("*").alias("frame_count"), F.count_if(F.col("msms_type") == 0).alias("ms1_count"), F.count_if(F.col("msms_type") != 0).alias("ms2_count"),
        F.coalesce(F.min("time"), F.lit(0.0)).alias("time_min"), F.coalesce(F.max("time"), F.lit(0.0)).alias("time_max"),
    )
