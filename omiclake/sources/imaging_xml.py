"""imzML (an XML part and a binary part side by side) and nmrML."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omiclake.sources.spectra_xml import INTENSITY, KINDS, MZ, decode

#: Accessions of the imaging vocabulary.
CONTINUOUS, PROCESSED, UUID = "IMS:1000030", "IMS:1000031", "IMS:1000080"
X, Y, Z, OFFSET, LENGTH = "IMS:1000050", "IMS:1000051", "IMS:1000052", "IMS:1000102", "IMS:1000103"


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _params(e: ElementTree.Element) -> dict[str, str]:
    return {c.get("accession"): c.get("value", "") for c in e.iter() if _tag(c) == "cvParam"}


def pixels(xml: bytes, ibd: bytes) -> Iterator[dict]:
    """One dict for each pixel. The parts' identifiers must agree; an array past the binary part's end raises."""
    groups: dict[str, dict[str, str]] = {}
    mode, at = PROCESSED, 0
    for _, e in ElementTree.iterparse(io.BytesIO(xml)):
        if _tag(e) == "fileContent":
            own = _params(e)
            mode = CONTINUOUS if CONTINUOUS in own else PROCESSED
            named = own.get(UUID, "").strip("{}").replace("-", "").lower()
            if named and named != ibd[:16].hex():
                raise ValueError("the parts' identifiers differ")
        elif _tag(e) == "referenceableParamGroup":
            groups[e.get("id")] = _params(e)
        elif _tag(e) == "spectrum":
            row = {"pixel_index": at, "mode": "continuous" if mode == CONTINUOUS else "processed", "z": 1}
            place = next((_params(s) for s in e.iter() if _tag(s) == "scan"), {})
            row |= {k: int(place[a]) for k, a in (("x", X), ("y", Y), ("z", Z)) if a in place}
            for d in (d for d in e.iter() if _tag(d) == "binaryDataArray"):
                own = _params(d)
                for r in (r for r in d if _tag(r) == "referenceableParamGroupRef"):
                    own = groups.get(r.get("ref"), {}) | own
                kind = np.dtype(next((k for a, k in KINDS.items() if a in own), "<f8"))
                start, n = int(own[OFFSET]), int(own[LENGTH])
                if start + n * kind.itemsize > len(ibd):
                    raise ValueError(f"pixel {at}: its array lies past the end")
                row["mz" if MZ in own else "intensity"] = np.frombuffer(ibd, kind, n, start).astype(float).tolist()
            if len(row.get("mz", [])) != len(row.get("intensity", [])):
                raise ValueError(f"pixel {at}: arrays of unequal length")
            yield row
            at += 1
            e.clear()


PIXELS = pa.schema([("path", pa.string()), ("pixel_index", pa.int64()), ("mode", pa.string()), ("x", pa.int32()), ("y", pa.int32()), ("z", pa.int32()), ("mz", pa.list_(pa.float64())), ("intensity", pa.list_(pa.float64()))])


def imzml(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of the pairs name.imzML and name.ibd in a folder, a pair to a task."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    base = F.regexp_replace("path", r"\.[^.]*$", "").alias("base")
    xml = files.where(F.lower("path").endswith(".imzml")).select(base, "path", F.col("content").alias("xml"))
    pair = xml.join(files.where(F.lower("path").endswith(".ibd")).select(base, F.col("content").alias("ibd")), "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, x, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = []
                for p in pixels(x, i):
                    rows.append(p | {"path": path})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, PIXELS)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, PIXELS)

    return pair.select("path", "xml", "ibd").mapInArrow(run, "path string, pixel_index bigint, mode string, x int, y int, z int, mz array<double>, intensity array<double>")


def imzml_bytes(rows: list[dict], continuous: bool = False, ident: uuid.UUID | None = None) -> tuple[str, bytes]:
    """The two parts of pixels (x, y, mz, intensity); continuous ones share the first pixel's m/z."""
    ident = ident or uuid.uuid4()
    ibd, spectra, shared = bytearray(ident.bytes), [], None

    def put(values: list[float]) -> tuple[int, int]:
        at = len(ibd)
        ibd.extend(np.array(values, "<f8").tobytes())
        return at, len(values)

    def array(accession: str, place: tuple[int, int]) -> str:
        return f'<binaryDataArray encodedLength="0"><cvParam accession="{accession}"/><cvParam accession="MS:1000523"/><cvParam accession="{OFFSET}" value="{place[0]}"/><cvParam accession="{LENGTH}" value="{place[1]}"/><binary/></binaryDataArray>'

    for i, r in enumerate(rows):
        if continuous:
            shared = shared or (put(r["mz"]), r["mz"])
            if shared[1] != r["mz"]:
                raise ValueError("continuous pixels share their m/z")
        place = shared[0] if continuous else put(r["mz"])
        spectra.append(f'<spectrum id="Scan={i + 1}" index="{i}"><scanList><scan><cvParam accession="{X}" value="{r["x"]}"/><cvParam accession="{Y}" value="{r["y"]}"/></scan></scanList><binaryDataArrayList>{array(MZ, place)}{array(INTENSITY, put(r["intensity"]))}</binaryDataArrayList></spectrum>')
    head = f'<fileDescription><fileContent><cvParam accession="{CONTINUOUS if continuous else PROCESSED}"/><cvParam accession="{UUID}" value="{ident}"/></fileContent></fileDescription>'
    return f'<?xml version="1.0"?>\n<mzML>{head}<run><spectrumList count="{len(rows)}">{"".join(spectra)}</spectrumList></run></mzML>', bytes(ibd)


def nmrml_spectrum(xml: bytes) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the first 1-D spectrum: 2N values are pairs, N values are y over 0 to N - 1; without N an even number is pairs."""
    for _, e in ElementTree.iterparse(io.BytesIO(xml)):
        if _tag(e) == "spectrum1D":
            d = next(x for x in e.iter() if _tag(x) == "spectrumDataArray")
            packed = d.get("compressed", "false").lower() in ("true", "zlib")
            v = decode("".join((d.text or "").split()), {"float32": "<f4", "float64": "<f8", "int32": "<i4"}.get(d.get("byteFormat", "float64").lower(), "<f8"), packed)
            n = int(e.get("numberOfDataPoints", 0))
            if (n and len(v) == 2 * n) or (not n and len(v) % 2 == 0):
                return v[0::2], v[1::2]
            return np.arange(len(v), dtype=float), v
    raise ValueError("no 1-D spectrum")


def nmrml_text(x: list[float], y: list[float]) -> str:
    import base64

    data = base64.b64encode(np.stack([x, y], axis=1).astype("<f8").tobytes()).decode()
    return f'<?xml version="1.0"?>\n<nmrML><spectrumList><spectrum1D id="s1" numberOfDataPoints="{len(x)}"><spectrumDataArray compressed="false" byteFormat="float64">{data}</spectrumDataArray></spectrum1D></spectrumList></nmrML>'


def nmrml(spark: SparkSession, path: str) -> DataFrame:
    """path, chemical_shift and intensity of nmrML files."""
    schema = pa.schema([("path", pa.string()), ("chemical_shift", pa.list_(pa.float64())), ("intensity", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = nmrml_spectrum(data)
                rows.append({"path": p, "chemical_shift": x.tolist(), "intensity": y.tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, chemical_shift array<double>, intensity array<double>")
