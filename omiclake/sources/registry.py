"""Formats by name and ending: readers and writers to choose from, and Python data sources for spark.read.format."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from omiclake.sources import bam, imaging_xml, spectra_xml, text_formats


class Reader(Protocol):
    """Reads a path into a table."""

    def __call__(self, spark: SparkSession, path: str) -> DataFrame: ...


class Writer(Protocol):
    """Writes a table to a path."""

    def __call__(self, table: DataFrame, path: str) -> None: ...


@dataclass
class Format:
    name: str
    endings: tuple[str, ...]
    read: Reader | None = None
    write: Writer | None = None
    aliases: tuple[str, ...] = ()


FORMATS: dict[str, Format] = {}


def register(f: Format) -> None:
    """A format of the same name takes the other's place."""
    FORMATS[f.name] = f


def normalised(name: str) -> str:
    """A format's own name, of any of its aliases in any case, with or without dashes; an unknown one raises ValueError."""
    key = name.lower().replace("-", "").replace("_", "").lstrip(".")
    for f in FORMATS.values():
        if key in {f.name, *f.aliases}:
            return f.name
    raise ValueError(f"unknown format {name!r}; known are {', '.join(sorted(FORMATS))}")


def format_of(path: str) -> str:
    """The format whose longest ending the path has, .gz apart."""
    bare = path.lower().rstrip("/").removesuffix(".gz")
    found = [(len(e), f.name) for f in FORMATS.values() for e in f.endings if bare.endswith(e)]
    if not found:
        raise ValueError(f"no format for {path!r}")
    return max(found)[1]


def import_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    f = FORMATS[normalised(name) if name else format_of(path)]
    if f.read is None:
        raise ValueError(f"{f.name} can't be read")
    return f.read(spark, path)


def export_table(table: DataFrame, path: str, name: str | None = None) -> None:
    f = FORMATS[normalised(name) if name else format_of(path)]
    if f.write is None:
        raise ValueError(f"{f.name} can't be written")
    f.write(table, path)


def _lines(of: Callable[[DataFrame], DataFrame]) -> Writer:
    """Writes the value column of ordered lines as text."""

    def write(table: DataFrame, path: str) -> None:
        rows = of(table)
        rows = rows.orderBy("ordinal") if "ordinal" in rows.columns else rows
        rows.select("value").write.text(path)

    return write


def _fasta(table: DataFrame) -> DataFrame:
    from omiclake.sinks.text_lines import fasta_lines

    return fasta_lines(table)


register(Format("fasta", (".fasta", ".fa", ".fna"), text_formats.fasta_reads, _lines(_fasta), ("fa", "fna")))
register(Format("fastq", (".fastq", ".fq"), text_formats.fastq_lines, None, ("fq",)))
register(Format("sam", (".sam",), lambda spark, path: text_formats.sam(spark.read.text(path)), None))
register(Format("bam", (".bam",), bam.bam, None))
register(Format("jcamp", (".jdx", ".dx", ".jcm"), lambda spark, path: text_formats.jcamp(text_formats.whole_files(spark, path)), None, ("jcampdx", "jdx", "dx")))
register(Format("mztab", (".mztab",), lambda spark, path: text_formats.mztab_identifications(text_formats.numbered_lines(text_formats.whole_files(spark, path)))))
register(Format("gfa", (".gfa",), lambda spark, path: text_formats.numbered_lines(text_formats.whole_files(spark, path))))
register(Format("parquet", (".parquet",), lambda spark, path: spark.read.parquet(path), lambda table, path: table.write.parquet(path)))
for _name, _module, _ending in (("mzml", spectra_xml, ".mzml"), ("imzml", imaging_xml, ".imzml"), ("nmrml", imaging_xml, ".nmrml")):
    if hasattr(_module, _name):
        register(Format(_name, (_ending,), getattr(_module, _name), None))


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class BamSource(DataSource):
    """spark.read.format("omic_bam").option("path", ...): a list of files, parted by commas; each is a partition."""

    @classmethod
    def name(cls) -> str:
        return "omic_bam"

    def schema(self) -> str:
        return bam.READS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BamReader(self.options["path"].split(","))


class _BamReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: _Part):
        import pyarrow.fs

        fs, at = pyarrow.fs.FileSystem.from_uri(partition.path if "://" in partition.path else f"file://{partition.path}")
        with fs.open_input_stream(at) as f:
            data = f.read()
        names = bam.KIND.names
        for r in bam.records(data, at.rsplit("/", 1)[-1].removesuffix(".bam")):
            yield tuple(r[n] for n in names)


def register_sources(spark: SparkSession) -> None:
    """Makes the Python data sources known to a session."""
    spark.dataSource.register(BamSource)
