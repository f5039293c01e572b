"""Containers: a tree of groups and datasets with attributes, as Parquet folders that Spark prunes and appends to.

The tree is a small table of node events, the last of which holds; a dataset's rows lie in segments with their place idx.
Appending adds a segment; writing over a slice adds one too, whose rows replace those of the same place when read.
"""

from __future__ import annotations

import json
from math import prod
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from omiclake.operators.access import running

NODES = "seq bigint, path string, kind string, info string, attributes map<string,string>, gone boolean"


class Container:
    """One container under a folder. Paths are absolute, such as /runs/a/mz; parents are made with their children."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def nodes(self) -> DataFrame:
        """path, kind, info and attributes of every node there is."""
        try:
            rows = self.spark.read.schema(NODES).parquet(f"{self.folder}/nodes")
        except AnalysisException:
            rows = self.spark.createDataFrame([], NODES)
        last = rows.groupBy("path").agg(F.max_by(F.struct("kind", "info", "attributes", "gone"), "seq").alias("n"), F.max("seq").alias("seq"))
        return last.where("NOT n.gone").select("path", "n.kind", "n.info", "n.attributes", "seq")

    def _put(self, path: str, kind: str, info: dict | None = None, attributes: dict[str, str] | None = None, gone: bool = False) -> None:
        try:
            seq = (self.spark.read.schema(NODES).parquet(f"{self.folder}/nodes").agg(F.max("seq")).first()[0] or 0) + 1
        except AnalysisException:
            seq = 1
        row = (seq, path, kind, json.dumps(info or {}), attributes or {}, gone)
        self.spark.createDataFrame([row], NODES).coalesce(1).write.mode("append").parquet(f"{self.folder}/nodes")

    def _node(self, path: str):
        found = self.nodes().where(F.col("path") == path).first()
        if found is None:
            raise KeyError(path)
        return found

    def exists(self, path: str) -> bool:
        return not self.nodes().where(F.col("path") == path).isEmpty()

    def create_group(self, path: str) -> None:
        """The group and those above it; groups that exist stay as they are."""
        parts = path.strip("/").split("/")
        for k in range(1, len(parts) + 1):
            if not self.exists(at := "/" + "/".join(parts[:k])):
                self._put(at, "group")

    def child_names(self, path: str = "/") -> list[str]:
        own = path.rstrip("/") + "/"
        names = self.nodes().where(F.col("path").startswith(own)).select(F.substring("path", len(own) + 1, 1 << 16).alias("name"))
        return [r["name"] for r in names.where(~F.col("name").contains("/")).orderBy("name").collect()]

    def delete_child(self, path: str) -> None:
        """The node and all below it; segments stay on disk, unread."""
        for r in self.nodes().where((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/")).collect():
            self._put(r["path"], r["kind"], gone=True)

    def attributes(self, path: str) -> dict[str, Any]:
        return {k: json.loads(v) for k, v in self._node(path)["attributes"].items()}

    def get_attribute(self, path: str, name: str) -> Any:
        return self.attributes(path)[name]

    def set_attribute(self, path: str, name: str, value: Any) -> None:
        n = self._node(path)
        self._put(path, n["kind"], json.loads(n["info"]), n["attributes"] | {name: json.dumps(value)})

    def _segments(self, path: str) -> str:
        return f"{self.folder}/data{path}/{json.loads(self._node(path)['info'])['id']}"

    def _write(self, path: str, rows: DataFrame, segment: int) -> None:
        rows.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment").parquet(self._segments(path))

    def create_dataset(self, path: str, rows: DataFrame, shape: tuple[int, ...] | None = None) -> None:
        """rows: idx, the place in the flat dataset from 0, and one column (a primitive or N-D dataset) or more (a compound one)."""
        if self.exists(path):
            raise ValueError(f"{path} exists")
        if "idx" not in rows.columns:
            raise ValueError("rows need their place, idx")
        if "/" in path.strip("/"):
            self.create_group(path.rsplit("/", 1)[0])
        number = self.nodes().count()
        self._put(path, "dataset", {"id": f"d{number}", "shape": shape, "schema": rows.schema.json()})
        self._write(path, rows, 0)

    def _last(self, path: str) -> int:
        return self.spark.read.parquet(self._segments(path)).agg(F.max("segment")).first()[0] or 0

    def append(self, path: str, rows: DataFrame) -> None:
        """rows with places idx of their own, from 0, go after the last one; a fixed shape doesn't grow."""
        if self.shape(path) is not None:
            raise ValueError(f"{path} has a fixed shape")
        self._write(path, rows.withColumn("idx", F.col("idx") + F.lit(self.length(path))), self._last(path) + 1)

    def write_slice(self, path: str, offset: int, rows: DataFrame) -> None:
        """rows with places from 0 replace those from offset on; none may lie beyond the end."""
        most = rows.agg(F.max("idx")).first()[0]
        if most is not None and offset + most >= self.length(path):
            raise IndexError(f"{path} ends before {offset + most}")
        self._write(path, rows.withColumn("idx", F.col("idx") + F.lit(offset)), self._last(path) + 1)

    def read(self, path: str, start: int | None = None, stop: int | None = None) -> DataFrame:
        """The rows of places start to stop, idx among them; both reach the scan."""
        rows = self.spark.read.parquet(self._segments(path))
        rows = rows if start is None else rows.where(F.col("idx") >= start)
        rows = rows if stop is None else rows.where(F.col("idx") < stop)
        names = [c for c in rows.columns if c not in ("idx", "segment")]
        if self._last(path) == 0:
            return rows.drop("segment")
        return rows.groupBy("idx").agg(F.max_by(F.struct(*names), "segment").alias("_v")).select("idx", "_v.*")

    def length(self, path: str) -> int:
        most = self.spark.read.parquet(self._segments(path)).agg(F.max("idx")).first()[0]
        return 0 if most is None else most + 1

    def shape(self, path: str) -> tuple[int, ...] | None:
        s = json.loads(self._node(path)["info"])["shape"]
        return tuple(s) if s else None

    def read_box(self, path: str, low: tuple[int, ...], high: tuple[int, ...]) -> DataFrame:
        """Cells low to high (half open) of an N-D dataset with their coordinates i0, i1, ...; row-major."""
        shape = self.shape(path)
        steps = [prod(shape[k + 1 :]) for k in range(len(shape))]
        first = sum(a * s for a, s in zip(low, steps, strict=True))
        last = sum((b - 1) * s for b, s in zip(high, steps, strict=True))
        cells = self.read(path, first, last + 1)
        cells = cells.withColumns({f"i{k}": F.pmod(F.floor(F.col("idx") / s), F.lit(n)) for k, (s, n) in enumerate(zip(steps, shape, strict=True))})
        for k, (a, b) in enumerate(zip(low, high, strict=True)):
            cells = cells.where((F.col(f"i{k}") >= a) & (F.col(f"i{k}") < b))
        return cells


def signal_chunks(spectra: DataFrame, channels: list[str], size: int = 1 << 16, order: str = "spectrum_index") -> tuple[DataFrame, DataFrame]:
    """An index (order, offset, length) and chunks (chunk and an array for each channel, of at most size values) of a run's signals laid end to end."""
    index = running(spectra.select(order, F.size(channels[0]).alias("length")), order, "length", "offset").select(order, F.col("offset").cast("long").alias("offset"), "length")
    each = spectra.join(index, order).select("offset", F.posexplode(F.arrays_zip(*channels)).alias("_i", "_v"))
    at = F.col("offset") + F.col("_i")
    cells = each.select(F.floor(at / size).alias("chunk"), F.struct(at.alias("at"), *[F.col(f"_v.{c}").alias(c) for c in channels]).alias("_v"))
    chunks = cells.groupBy("chunk").agg(F.array_sort(F.collect_list("_v")).alias("_v"))
    return index, chunks.select("chunk", *[F.col(f"_v.{c}").alias(c) for c in channels])


def assembled(index: DataFrame, chunks: DataFrame, channels: list[str], size: int = 1 << 16, order: str = "spectrum_index") -> DataFrame:
    """Spectra of an index and its chunks: each opens the chunks that it reaches into, by an equi-join; empty ones stay, with empty arrays."""
    last = F.floor((F.col("offset") + F.greatest(F.col("length"), F.lit(1)) - 1) / size)
    own = index.select(order, "offset", "length", F.explode(F.sequence(F.floor(F.col("offset") / size), last)).alias("chunk"))
    first = F.greatest(F.col("offset") - F.col("chunk") * size, F.lit(0)).cast("int")
    upto = F.least(F.col("offset") + F.col("length") - F.col("chunk") * size, F.lit(size)).cast("int")
    n = F.greatest(upto - first, F.lit(0))
    part = F.struct("chunk", *[F.slice(F.coalesce(F.col(c), F.array()), first + 1, n).alias(c) for c in channels])
    parts = own.join(chunks, "chunk", "left").groupBy(order).agg(F.array_sort(F.collect_list(part)).alias("_p"))
    return parts.select(order, *[F.flatten(F.col(f"_p.{c}")).alias(c) for c in channels])


PROVIDERS: dict[str, Any] = {}


def register_provider(scheme: str, make) -> None:
    """make(spark, url) opens a container for urls of a scheme."""
    PROVIDERS[scheme] = make


register_provider("parquet", lambda spark, url: Container(spark, url.split("://", 1)[1]))


def open_container(spark: SparkSession, url: str) -> Container:
    """A container by its url; without a known scheme it is a folder that Spark reads."""
    scheme = url.split("://", 1)[0] if "://" in url else ""
    return PROVIDERS[scheme](spark, url) if scheme in PROVIDERS else Container(spark, url)
