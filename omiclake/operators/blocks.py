"""User functions over blocks of a run, columns of a block, progress, and visits of a stream's units."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_number(order: Column, size: int) -> Column:
    return F.floor(order / size).cast("long")


def for_each_block(run: DataFrame, fn: Callable[[int, pa.Table], pa.Table], schema: str, order: str = "spectrum_index", size: int = 1024, start: int | None = None, stop: int | None = None) -> DataFrame:
    """What fn(block, rows) gives for each block of size consecutive places, start to stop; blocks go to tasks in no order.

    Rows of a block are in order. Works on spectra and on reads alike; only columns that run has are read.
    """
    rows = run if start is None else run.where(F.col(order) >= start)
    rows = rows if stop is None else rows.where(F.col(order) < stop)
    dealt = rows.withColumn("_block", block_number(F.col(order), size))

    def one(t: pa.Table) -> pa.Table:
        return fn(t["_block"][0].as_py(), t.drop_columns(["_block"]).sort_by(order))

    return dealt.groupBy("_block").applyInArrow(one, schema)


def block_column(run: DataFrame, column: str, block: int, order: str = "spectrum_index", size: int = 1024) -> pa.ChunkedArray:
    """One column of one block as Arrow values, in order; only that column and the order are scanned."""
    own = run.where((F.col(order) >= block * size) & (F.col(order) < (block + 1) * size))
    return own.select(order, column).toArrow().sort_by(order)[column]


def block_budget(lengths: DataFrame, budget: int, order: str = "read_index", size: str = "bytes") -> DataFrame:
    """first, rows and bytes of blocks of consecutive rows of about budget bytes each: a row belongs to the block that its first byte falls in.

    A block holds at least one row; places come from running sums over ranges, so no task holds a run.
    """
    from omiclake.operators.access import running

    placed = running(lengths.select(order, F.col(size).cast("long").alias(size)), order, size, "_at")
    block = F.floor(F.col("_at") / budget).alias("_b")
    return placed.groupBy(block).agg(F.min(order).alias("first"), F.count("*").alias("rows"), F.sum(size).alias("bytes")).drop("_b")


class Progress:
    """Calls sink(done, total) after each part of a DataFrame's rows that a task has written; the parts' counts alone reach the driver."""

    def __init__(self, sink: Callable[[int, int], None]) -> None:
        self.sink = sink

    def run(self, df: DataFrame, write: Callable[[DataFrame], None], parts: int = 8) -> None:
        """write is called with parts of df, split by a hash of the rows, one after another."""
        key = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
        for k in range(parts):
            write(df.where(key == k))
            self.sink(k + 1, parts)


def visited(units: DataFrame, visitor, order: list[str] | None = None) -> None:
    """Calls visitor.unit(row) for each unit in stream order, then visitor.end(); a partition at a time is in memory."""
    rows: Iterator = units.orderBy(*(order or ["dataset_id", "au_sequence"])).toLocalIterator(prefetchPartitions=True)
    for r in rows:
        visitor.unit(r)
    visitor.end()


def stream_union(*streams: DataFrame) -> DataFrame:
    """Units of several streams as one: datasets are renumbered so that none clashes, by each stream's place."""
    out = None
    for k, s in enumerate(streams):
        own = s.withColumn("dataset_id", F.col("dataset_id") * len(streams) + k)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def runs_of_modality(runs: DataFrame, modality: str) -> DataFrame:
    return runs.where(F.lower("modality") == modality.lower())


def read_length(sequence: Column, cigar: Column) -> Column:
    """Bases of a read: those of its sequence or, where it is empty, those that its CIGAR takes from a read (M, I, S, =, X)."""
    ops = F.regexp_extract_all(cigar, F.lit(r"([0-9]+)[MIS=X]"), F.lit(1))
    counted = F.aggregate(ops, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return F.when(F.coalesce(F.length(sequence), F.lit(0)) > 0, F.length(sequence).cast("long")).otherwise(F.coalesce(counted, F.lit(0).cast("long")))


def reference_slice(references: DataFrame, uri: str, chromosome: str, start: int, stop: int, width: int = 1 << 20) -> DataFrame:
    """The bases start to stop (from 0, half open) of a chromosome, of a table of (uri, chromosome, part, sequence) in parts of width bases."""
    part = references.where((F.col("uri") == uri) & (F.col("chromosome") == chromosome) & F.col("part").between(start // width, max(start, stop - 1) // width))
    first = F.greatest(F.lit(start) - F.col("part") * width, F.lit(0))
    last = F.least(F.lit(stop) - F.col("part") * width, F.lit(width))
    piece = F.struct("part", F.substring("sequence", (first + 1).cast("int"), (last - first).cast("int")).alias("s"))
    return part.agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["s"]), "").alias("bases"))


def reference_parts(chromosomes: DataFrame, uri: str, width: int = 1 << 20) -> DataFrame:
    """uri, chromosome, part and sequence: chromosomes (name, sequence) cut into parts, so that no row holds a genome."""
    many = F.greatest(F.ceil(F.length("sequence") / width), F.lit(1)).cast("int")
    cut = chromosomes.select("name", "sequence", F.explode(F.sequence(F.lit(0), many - 1)).alias("part"))
    return cut.select(F.lit(uri).alias("uri"), F.col("name").alias("chromosome"), "part", F.substring("sequence", (F.col("part") * width + 1).cast("int"), F.lit(width)).alias("sequence"))


def joined_parts(pieces: DataFrame, uri: str, chromosome: str, order: str, width: int = 1 << 20) -> DataFrame:
    """The same table of a chromosome that comes as pieces (sequence, by a whole-numbered unique order), laid end to end; no task holds it."""
    from omiclake.operators.access import running

    n = F.length("sequence")
    at = running(pieces.where(n > 0).select(order, "sequence", n.alias("_n")), order, "_n", "_at")
    cut = at.select("sequence", "_n", "_at", F.explode(F.sequence(F.floor(F.col("_at") / width), F.floor((F.col("_at") + F.col("_n") - 1) / width))).alias("part"))
    first = F.greatest(F.col("part") * width - F.col("_at"), F.lit(0))
    last = F.least((F.col("part") + 1) * width - F.col("_at"), F.col("_n"))
    cut = cut.select("part", F.struct(F.col("_at"), F.substring("sequence", (first + 1).cast("int"), (last - first).cast("int")).alias("s")).alias("piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["s"]), "")
    return cut.groupBy("part").agg(whole.alias("sequence")).select(F.lit(uri).alias("uri"), F.lit(chromosome).alias("chromosome"), "part", "sequence")


def reference_slices(references: DataFrame, uri: str, chromosome: str, ranges: DataFrame, width: int = 1 << 20) -> DataFrame:
    """ranges (start, stop, and columns that tell them apart) with bases, as reference_slice gives them, in one pass over the parts."""
    keys = ranges.columns
    wanted = ranges.select("*", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("start"), F.col("stop") - 1) / width))).alias("part"))
    found = wanted.join(references.where((F.col("uri") == uri) & (F.col("chromosome") == chromosome)).select("part", "sequence"), "part", "left")
    first = F.greatest(F.col("start") - F.col("part") * width, F.lit(0))
    last = F.least(F.col("stop") - F.col("part") * width, F.lit(width))
    piece = F.struct("part", F.substring("sequence", (first + 1).cast("int"), (last - first).cast("int")).alias("s"))
    return found.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["s"]), "").alias("bases"))


def nmr_shape(spectra: DataFrame) -> DataFrame:
    """run_name, rows and columns of 2-D spectra: the number of traces and the one number of points that all have; a ragged run raises."""
    n = F.size("intensity")
    ragged = F.when(F.min(n) != F.max(n), F.raise_error(F.lit("traces differ in length")).cast("int")).otherwise(F.max(n))
    return spectra.groupBy("run_name").agg(F.count("*").alias("rows"), ragged.alias("columns"))


def spectral_axis(first: float, last: float, n: int) -> Column:
    """n evenly spaced values from first to last, as the spectral axis of an image cube."""
    step = (last - first) / (n - 1) if n > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(first)) + i * F.lit(step)) if n else F.array().cast("array<double>")


def image_of_kind(images: DataFrame, kind: str) -> DataFrame:
    """The pixels of the image of a kind; none, or several names of it, raise."""
    found = images.where(F.col("kind") == kind)
    names = found.select("image_name").distinct().limit(2).collect()
    if len(names) != 1:
        raise KeyError(kind) if not names else ValueError(f"several images of kind {kind}")
    return found
