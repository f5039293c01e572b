"""Predicates over index columns. They compile to Columns, so scans prune and push them; signals stay unread.

Three kinds of interval, as the data model has them: retention time, m/z and stream positions are closed;
an index region is half-open over the start position; a masking region is a closed overlap.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Polarity as stored (1, -1, 0), on the wire (0, 1, 2) and by name.
STORED_TO_WIRE = {1: 0, -1: 1}
NAMED_TO_WIRE = {"positive": 0, "negative": 1, "unknown": 2}
GENOMIC_CLASS = 5

#: SAM flag bits.
PAIRED, UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 0x1, 0x4, 0x10, 0x100, 0x800


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def closed(c: Column, low: float, high: float) -> Column:
    """low <= c <= high; NaN is outside (Spark would take it for the largest number)."""
    return (c >= low) & (c <= high) & ~F.isnan(c.cast("double"))


def contains(c: Column, low: float, high: float) -> Column:
    return closed(c, low, high)


def span(low: Column, high: Column) -> Column:
    return high - low


@dataclass(frozen=True)
class IndexQuery:
    """Conjunctive query over a spectrum index. Each setter gives a new query; the last of a kind holds."""

    retention_time: tuple[float, float] | None = None
    ms_level: int | None = None
    polarity: int | None = None
    precursor_mz: tuple[float, float] | None = None
    base_peak: float | None = None

    def with_retention_time_range(self, low: float, high: float) -> IndexQuery:
        return replace(self, retention_time=(low, high))

    def with_ms_level(self, level: int) -> IndexQuery:
        return replace(self, ms_level=level)

    def with_polarity(self, code: int) -> IndexQuery:
        return replace(self, polarity=code)

    def with_precursor_mz_range(self, low: float, high: float) -> IndexQuery:
        return replace(self, precursor_mz=(low, high))

    def with_base_peak_intensity_at_least(self, threshold: float) -> IndexQuery:
        return replace(self, base_peak=threshold)

    def column(self) -> Column:
        parts = []
        if self.retention_time:
            parts.append(closed(F.col("retention_time"), *self.retention_time))
        if self.ms_level is not None:
            parts.append(F.col("ms_level") == self.ms_level)
        if self.polarity is not None:
            parts.append(F.col("polarity") == self.polarity)
        if self.precursor_mz:
            parts.append(closed(F.col("precursor_mz"), *self.precursor_mz))
        if self.base_peak is not None:
            parts.append((F.col("base_peak_intensity") >= self.base_peak) & ~F.isnan("base_peak_intensity"))
        return all_of(parts)

    def on(self, index: DataFrame, run_name: str | None = None) -> DataFrame:
        """The index rows that match, of one run or of all. Sort by spectrum_index where order matters."""
        rows = index if run_name is None else index.where(F.col("run_name") == run_name)
        return rows.where(self.column())


def in_region(chromosome: str, start: int, end: int) -> Column:
    """Reads whose position lies in [start, end); an earlier read that reaches in isn't one."""
    return (F.col("chromosome") == chromosome) & (F.col("position") >= start) & (F.col("position") < end)


def has_flag(mask: int, flags: str = "flags") -> Column:
    """Any bit of the mask set."""
    return F.col(flags).bitwiseAND(F.lit(mask)) != 0


def with_read_flags(reads: DataFrame) -> DataFrame:
    return reads.withColumns({
        "is_mapped": ~has_flag(UNMAPPED), "is_paired": has_flag(PAIRED), "is_reverse": has_flag(REVERSE),
        "is_secondary": has_flag(SECONDARY), "is_supplementary": has_flag(SUPPLEMENTARY),
    })


@dataclass(frozen=True)
class UnitFilter:
    """Filter of stream access units. NaN passes its ranges: only values outside are refused."""

    dataset_id: int | None = None
    rt_min: float | None = None
    rt_max: float | None = None
    ms_level: int | None = None
    precursor_mz_min: float | None = None
    precursor_mz_max: float | None = None
    polarity: int | None = None
    precursor_charge: int | None = None
    chromosome: str | None = None
    position_min: int | None = None
    position_max: int | None = None
    max_au: int | None = None

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> UnitFilter:
        """Unknown keys are ignored, the long key names accepted, nulls skipped; a bad number raises ValueError."""
        long = {"retention_time_min": "rt_min", "retention_time_max": "rt_max"}
        kinds = {f.name: float if "rt_" in f.name or "_mz_" in f.name else str if f.name == "chromosome" else int for f in fields(cls)}
        out = {}
        for k, v in data.items():
            k = long.get(k, k)
            if k in kinds and v is not None:
                if k == "polarity" and isinstance(v, str) and v in NAMED_TO_WIRE:
                    v = NAMED_TO_WIRE[v]
                out[k] = kinds[k](v)
        return cls(**out)

    @classmethod
    def from_json(cls, text: str | None) -> UnitFilter:
        """Of a client's message; anything that isn't an object of filters accepts all."""
        try:
            data = json.loads(text or "")
            data = data.get("filters", data) if isinstance(data, dict) else {}
        except ValueError:
            data = {}
        return cls.from_dict(data if isinstance(data, dict) else {})

    def column(self) -> Column:
        nan = lambda c: F.isnan(F.col(c))
        parts = [F.col(c) == v for c, v in (("dataset_id", self.dataset_id), ("ms_level", self.ms_level), ("polarity", self.polarity), ("precursor_charge", self.precursor_charge)) if v is not None]
        for c, low, high in (("retention_time", self.rt_min, self.rt_max), ("precursor_mz", self.precursor_mz_min, self.precursor_mz_max)):
            parts += [] if low is None else [(F.col(c) >= low) | nan(c)]
            parts += [] if high is None else [(F.col(c) <= high) | nan(c)]
        genomic = F.col("spectrum_class") == GENOMIC_CLASS
        parts += [] if self.chromosome is None else [genomic & (F.col("chromosome") == self.chromosome)]
        parts += [] if self.position_min is None else [genomic & (F.col("position") >= self.position_min)]
        parts += [] if self.position_max is None else [genomic & (F.col("position") <= self.position_max)]
        return all_of(parts)

    def on(self, units: DataFrame) -> DataFrame:
        """Matching units; with max_au the first so many of all in stream order: genomic datasets after all others."""
        out = units.where(self.column())
        return out if self.max_au is None else out.orderBy((F.col("spectrum_class") == GENOMIC_CLASS).cast("int"), "dataset_id", "au_sequence").limit(self.max_au)

    def to_dict(self) -> dict[str, Any]:
        """The filters that are set, under the keys that from_dict takes."""
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}

    def to_json(self) -> str:
        """A client's message, as from_json reads it."""
        return json.dumps({"filters": self.to_dict()}, sort_keys=True)


def parse_pairs(values: list[str]) -> dict[str, Any]:
    """key=value texts; a value is read as an int, else a float, else text."""
    out: dict[str, Any] = {}
    for v in values:
        k, eq, x = v.partition("=")
        if not eq or not k:
            raise ValueError(f"expected key=value, got {v!r}")
        for kind in (int, float, str):
            try:
                out[k] = kind(x)
                break
            except ValueError:
                continue
    return out


def isolation_window(target: Column, lower: Column, upper: Column) -> Column:
    """Struct of target_mz, lower, upper and width; null where all three are 0 or absent."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    none = (z(target) == 0) & (z(lower) == 0) & (z(upper) == 0)
    low, high = z(target) - z(lower), z(target) + z(upper)
    return F.when(~none, F.struct(z(target).alias("target_mz"), low.alias("lower"), high.alias("upper"), (z(lower) + z(upper)).alias("width")))


def pixel_coordinates(x: Column, y: Column, z: Column) -> Column:
    """Struct (x, y, z), or null where none is set; some set and others not is an error."""
    known = [c.isNotNull().cast("int") for c in (x, y, z)]
    n = known[0] + known[1] + known[2]
    return F.when(n == 3, F.struct(x.alias("x"), y.alias("y"), z.alias("z"))).when(n > 0, F.raise_error(F.lit("pixel columns must be all set or all absent")).cast("struct<x:int,y:int,z:int>"))


def annotations_of(params: Column, accession: str | None = None, ontology: str | None = None) -> Column:
    """The annotation structs with the accession, or of the ontology."""
    return F.filter(params, lambda p: p["accession"] == accession if accession is not None else p["ontology_ref"] == ontology)


def has_annotation(params: Column, accession: str) -> Column:
    return F.exists(params, lambda p: p["accession"] == accession)
