"""mzML: spectra of a file, parsed by events in bounded memory, with base64 and zlib arrays."""

from __future__ import annotations

import base64
import io
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Accessions of the controlled vocabulary that the reader maps.
KINDS = {"MS:1000523": "<f8", "MS:1000521": "<f4", "MS:1000519": "<i4", "MS:1000522": "<i8"}
ZLIB, MZ, INTENSITY = "MS:1000574", "MS:1000514", "MS:1000515"
LEVEL, POSITIVE, NEGATIVE, SCAN_START, MINUTES = "MS:1000511", "MS:1000130", "MS:1000129", "MS:1000016", "UO:0000031"
SELECTED_MZ, CHARGE = "MS:1000744", "MS:1000041"

SCHEMA = pa.schema([
    ("path", pa.string()), ("spectrum_index", pa.int64()), ("ms_level", pa.int32()), ("polarity", pa.int32()), ("retention_time", pa.float64()),
    ("precursor_mz", pa.float64()), ("precursor_charge", pa.int32()), ("mz", pa.list_(pa.float64())), ("intensity", pa.list_(pa.float64())), ("base_peak_intensity", pa.float64()),
])
DDL = "path string, spectrum_index bigint, ms_level int, polarity int, retention_time double, precursor_mz double, precursor_charge int, mz array<double>, intensity array<double>, base_peak_intensity double"


def decode(text: str, kind: str = "<f8", compressed: bool = False) -> np.ndarray:
    """A binary array's text as doubles."""
    data = base64.b64decode(text or "")
    return np.frombuffer(zlib.decompress(data) if compressed and data else data, kind).astype(float)


def spectra(data: bytes) -> Iterator[dict]:
    """One dict for each spectrum; an array whose length isn't the one declared raises."""
    tag = lambda e: e.tag.rpartition("}")[2]
    at = 0
    for _, e in ElementTree.iterparse(io.BytesIO(data)):
        if tag(e) != "spectrum":
            continue
        row = {"spectrum_index": at, "ms_level": 1, "polarity": 0, "retention_time": 0.0, "precursor_mz": 0.0, "precursor_charge": 0, "mz": [], "intensity": []}
        n = int(e.get("defaultArrayLength", 0))
        for x in e.iter():
            if tag(x) == "binaryDataArray":
                own = {c.get("accession") for c in x if tag(c) == "cvParam"}
                kind = next((k for a, k in KINDS.items() if a in own), "<f8")
                values = decode(next((c.text for c in x if tag(c) == "binary"), ""), kind, ZLIB in own)
                if len(values) != int(x.get("arrayLength", n)):
                    raise ValueError(f"spectrum {at}: {len(values)} values, {n} declared")
                row["mz" if MZ in own else "intensity" if INTENSITY in own else "other"] = values.tolist()
            elif tag(x) == "cvParam":
                a, v = x.get("accession"), x.get("value")
                if a == LEVEL:
                    row["ms_level"] = int(v)
                elif a in (POSITIVE, NEGATIVE):
                    row["polarity"] = 1 if a == POSITIVE else -1
                elif a == SCAN_START:
                    row["retention_time"] = float(v) * (60 if x.get("unitAccession") == MINUTES else 1)
                elif a == SELECTED_MZ:
                    row["precursor_mz"] = float(v)
                elif a == CHARGE:
                    row["precursor_charge"] = int(v)
        row.pop("other", None)
        row["base_peak_intensity"] = max(row["intensity"], default=0.0)
        yield row
        at += 1
        e.clear()


def mzml(spark: SparkSession, path: str, batch: int = 256) -> DataFrame:
    """Spectra of mzML files, a file to a task; Arrow batches of so many spectra."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for s in spectra(data):
                    rows.append(s | {"path": p})
                    if len(rows) == batch:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, DDL)


def mzml_text(rows: list[dict], compress: bool = True) -> str:
    """An mzML document of spectra in their order; scan ids count from 1."""

    def array(values: list[float], accession: str) -> str:
        data = np.array(values, "<f8").tobytes()
        text = base64.b64encode(zlib.compress(data) if compress else data).decode()
        packed = f'<cvParam accession="{ZLIB}"/>' if compress else ""
        return f'<binaryDataArray encodedLength="{len(text)}"><cvParam accession="MS:1000523"/>{packed}<cvParam accession="{accession}"/><binary>{text}</binary></binaryDataArray>'

    out = ['<?xml version="1.0" encoding="utf-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1.0"><run id="run"><spectrumList count="%d">' % len(rows)]
    for i, r in enumerate(rows):
        polarity = {1: f'<cvParam accession="{POSITIVE}"/>', -1: f'<cvParam accession="{NEGATIVE}"/>'}.get(r["polarity"], "")
        out.append(f'<spectrum index="{i}" id="scan={i + 1}" defaultArrayLength="{len(r["mz"])}"><cvParam accession="{LEVEL}" value="{r["ms_level"]}"/>{polarity}<scanList><scan><cvParam accession="{SCAN_START}" value="{r["retention_time"]!r}" unitAccession="UO:0000010"/></scan></scanList>')
        if r["precursor_mz"] > 0 or r["ms_level"] > 1:
            out.append(f'<precursorList><precursor><selectedIonList><selectedIon><cvParam accession="{SELECTED_MZ}" value="{r["precursor_mz"]!r}"/><cvParam accession="{CHARGE}" value="{r["precursor_charge"]}"/></selectedIon></selectedIonList></precursor></precursorList>')
        out.append(f'<binaryDataArrayList count="2">{array(r["mz"], MZ)}{array(r["intensity"], INTENSITY)}</binaryDataArrayList></spectrum>')
    return "".join([*out, "</spectrumList></run></mzML>"])
