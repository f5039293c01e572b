"""Reading parts: channel ranges, points, cursors, layers, tiles; and rows as Arrow bytes or canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F


def running(df: DataFrame, order: str, size: str, name: str, rows: int = 1 << 16) -> DataFrame:
    """df with the sum of size over the rows before each, by a whole-numbered unique order, in no single task.

    Rows are cut into ranges of the order; sums of ranges, which are few, give where each begins.
    """
    span = df.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).first()
    width = max(1, ((span["high"] or 0) - (span["low"] or 0) + 1) // max(1, -(-span["n"] // rows)))
    part = F.floor((F.col(order) - F.lit(span["low"] or 0)) / width)
    sums = df.groupBy(part.alias("_part")).agg(F.sum(size).alias("_sum"))
    first = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_part", part).withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return out.join(sums.select("_part", first.alias("_first")), "_part").withColumn(name, F.col("_first") + F.col("_in")).drop("_part", "_in", "_first")


def channel_range(run: DataFrame, channel: str, start: int, count: int, order: str = "spectrum_index") -> DataFrame:
    """order and value: values start to start + count of a run's channel laid end to end. Only spectra that hold some are opened."""
    places = running(run.select(order, F.size(channel).alias("_n")), order, "_n", "_at")
    own = places.where((F.col("_at") < start + count) & (F.col("_at") + F.col("_n") > start))
    first = F.greatest(F.lit(start) - F.col("_at"), F.lit(0)).cast("int")
    last = F.least(F.lit(start + count) - F.col("_at"), F.col("_n")).cast("int")
    return run.join(own, order).select(order, F.posexplode(F.slice(channel, first + 1, last - first)).alias("_i", "value")).orderBy(order, "_i").drop("_i")


def at_index(df: DataFrame, i: int, order: str) -> DataFrame:
    """The row of an ordinal; negative ones count from the end."""
    if i >= 0:
        return df.where(F.col(order) == i)
    return df.orderBy(F.col(order).desc()).limit(-i).orderBy(order).limit(1)


def in_range(df: DataFrame, start: int, stop: int, order: str) -> DataFrame:
    return df.where((F.col(order) >= start) & (F.col(order) < stop))


class Cursor:
    """Steps through rows in order, one partition in memory at a time."""

    def __init__(self, df: DataFrame, order: str) -> None:
        self.df, self.order = df, order
        self.seek(0)

    def seek(self, position: int) -> None:
        rows = self.df.where(F.col(self.order) >= position).orderBy(self.order)
        self.rows: Iterator[Row] = rows.toLocalIterator(prefetchPartitions=True)
        self.ahead = next(self.rows, None)

    def has_more(self) -> bool:
        return self.ahead is not None

    def next(self) -> Row:
        if self.ahead is None:
            raise StopIteration
        row, self.ahead = self.ahead, next(self.rows, None)
        return row


def one_run(runs: DataFrame, name: str | None = None, spectrum_class: str | None = None) -> DataFrame:
    """The named run, or the only one (of a class, if one has it); an unknown or unclear choice raises."""
    if name is not None:
        found = runs.where(F.col("run_name") == name)
        if found.isEmpty():
            raise KeyError(name)
        return found
    of_class = runs.where(F.col("spectrum_class") == spectrum_class) if spectrum_class else runs
    for choice in (of_class, runs):
        if len(choice.limit(2).collect()) == 1:
            return choice
    raise ValueError("name a run: there isn't just one")


def tiled(pixels: DataFrame, size: int = 32) -> DataFrame:
    """tile_x and tile_y, to partition a pixel table by when it is written."""
    return pixels.withColumns({"tile_x": F.floor(F.col("x") / size).cast("int"), "tile_y": F.floor(F.col("y") / size).cast("int")})


def has_feature(flags: Column, name: str) -> Column:
    return F.array_contains(flags, name)


def required_features(flags: Column) -> Column:
    """Flags without the prefix opt_ must be understood by a reader."""
    return F.filter(flags, lambda f: ~f.startswith("opt_"))


def json_list(text: Column) -> Column:
    """A JSON array of texts; an invalid or absent one is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_map(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def to_ipc(df: DataFrame) -> bytes:
    """A metadata table as one Arrow stream; for tables that fit the driver."""
    sink = pa.BufferOutputStream()
    t = df.toArrow()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def from_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    return spark.createDataFrame(pa.ipc.open_stream(data).read_all())


def canonical_json(value: Any) -> str:
    """Sorted keys, compact, floats with 17 significant digits."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(str(k))}:{canonical_json(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    return f"{value:.17g}" if isinstance(value, float) else json.dumps(value)
