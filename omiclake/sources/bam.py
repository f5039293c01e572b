"""BAM: records in blocked gzip, as rows of reads and back, without other tools."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Operations of a CIGAR and letters of a base, by their numbers; the empty block that ends a file.
OPERATIONS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
READS = "run_name string, read_index bigint, read_name string, chromosome string, position bigint, mapping_quality int, cigar string, sequence string, qualities binary, flags bigint, mate_chromosome string, mate_position bigint, template_length int, tags string"
_FIXED = struct.Struct("<iiBBHHHiiii")


def blocks(data: bytes) -> Iterator[bytes]:
    """The plain bytes of each block; anything that isn't blocked gzip raises ValueError."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not blocked gzip")
        (extra,) = struct.unpack_from("<H", data, at + 10)
        field, size = at + 12, None
        while field < at + 12 + extra:
            kind, n = data[field : field + 2], struct.unpack_from("<H", data, field + 2)[0]
            if kind == b"BC":
                (size,) = struct.unpack_from("<H", data, field + 4)
            field += 4 + n
        if size is None or at + size + 1 > len(data):
            raise ValueError("a block is cut short")
        yield zlib.decompress(data[at + 12 + extra : at + size - 7], -15)
        at += size + 1


def blocked(data: bytes, size: int = 0xFF00) -> bytes:
    """Blocked gzip of bytes, with the block that ends a file."""
    out = []
    for i in range(0, len(data), size):
        part = data[i : i + size]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join([*out, END])


def _tags(data: bytes) -> str:
    """Tags in the text form, tab-separated."""
    sizes = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
    out, at = [], 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            text, at = f"A:{chr(data[at])}", at + 1
        elif kind in "ZH":
            end = data.index(b"\0", at)
            text, at = f"{kind}:{data[at:end].decode()}", end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            form = "<" + sizes[sub][1:] * n
            values = struct.unpack_from(form, data, at + 5)
            text, at = f"B:{sub}," + ",".join(f"{v:g}" if sub == "f" else str(v) for v in values), at + 5 + struct.calcsize(form)
        else:
            (v,) = struct.unpack_from(sizes[kind], data, at)
            text, at = (f"f:{v:g}" if kind == "f" else f"i:{v}"), at + struct.calcsize(sizes[kind])
        out.append(f"{name}:{text}")
    return "\t".join(out)


def _tag_bytes(text: str) -> bytes:
    kinds, out = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}, []
    for tag in filter(None, text.split("\t")):
        name, kind, value = tag.split(":", 2)
        if kind == "A":
            body = b"A" + value.encode()
        elif kind == "i":
            body = struct.pack("<ci", b"i", int(value)) if -(2**31) <= int(value) < 2**31 else struct.pack("<cI", b"I", int(value))
        elif kind == "f":
            body = struct.pack("<cf", b"f", float(value))
        elif kind == "B":
            sub, *values = value.split(",")
            body = b"B" + sub.encode() + struct.pack(f"<I{len(values)}{kinds[sub]}", len(values), *((float if sub == "f" else int)(v) for v in values))
        else:
            body = kind.encode() + value.encode() + b"\0"
        out.append(name.encode() + body)
    return b"".join(out)


def records(data: bytes, run_name: str) -> Iterator[dict[str, Any]]:
    """The reads of a whole BAM file: positions from 1, empty sequence for none, qualities of 0xFF bytes where there are none."""
    f = io.BytesIO(b"".join(blocks(data)))
    if f.read(4) != b"BAM\1":
        raise ValueError("not BAM")
    f.read(struct.unpack("<i", f.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        names.append(f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode())
        f.read(4)
    of = lambda i: names[i] if i >= 0 else "*"
    k = 0
    while head := f.read(4):
        d = f.read(struct.unpack("<i", head)[0])
        ref, pos, n_name, mapq, _, n_ops, flags, n, mate, mate_pos, tlen = _FIXED.unpack_from(d)
        at = _FIXED.size
        name = d[at : at + n_name - 1].decode()
        at += n_name
        ops = struct.unpack_from(f"<{n_ops}I", d, at)
        at += 4 * n_ops
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in d[at : at + (n + 1) // 2])[:n]
        at += (n + 1) // 2
        yield {
            "run_name": run_name, "read_index": k, "read_name": name, "chromosome": of(ref), "position": pos + 1, "mapping_quality": mapq, "cigar": "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops) or "*",
            "sequence": seq, "qualities": d[at : at + n] if d[at : at + 1] == b"\xff" else bytes(q + 33 for q in d[at : at + n]), "flags": flags, "mate_chromosome": of(mate), "mate_position": mate_pos + 1,
            "template_length": tlen, "tags": _tags(d[at + n :]),
        }
        k += 1


def bam(spark: SparkSession, path: str) -> DataFrame:
    """Reads of BAM files, a file to a task and up to 2 GB each; the run is named by the file, ordinals count from 0 in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = []
                for r in records(data, name.rsplit("/", 1)[-1].removesuffix(".bam")):
                    part.append(r)
                    if len(part) == 10_000:
                        yield pa.RecordBatch.from_pylist(part, KIND)
                        part = []
                if part:
                    yield pa.RecordBatch.from_pylist(part, KIND)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, READS)


KIND = pa.schema([(f.split()[0], {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in READS.split(", ")])


def encoded(reads: Iterator[dict[str, Any]], references: dict[str, int], header: str = "") -> bytes:
    """A BAM file of reads in the order given; references: names with lengths, in their order. Qualities are bytes of the text form."""
    number = {c: i for i, c in enumerate(references)}
    text = (header or "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in references.items())).encode()
    out = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(references))]
    for c, n in references.items():
        out += [struct.pack("<i", len(c) + 1), c.encode(), b"\0", struct.pack("<i", n)]
    for r in reads:
        own, mate = number.get(r["chromosome"], -1), r.get("mate_chromosome") or "*"
        mate = own if mate == "=" else number.get(mate, -1)
        ops, n = [], ""
        for c in (r["cigar"] or "*").replace("*", ""):
            if c.isdigit():
                n += c
            else:
                ops.append(int(n) << 4 | OPERATIONS.index(c))
                n = ""
        seq, name = r["sequence"] or "", (r["read_name"] or "*").encode() + b"\0"
        nibbles = [BASES.find(c) if c in BASES else 15 for c in seq.upper()] + [0]
        q = bytes(r["qualities"] or b"")
        q = b"\xff" * len(seq) if len(q) != len(seq) or set(q) == {255} else bytes(x - 33 for x in q)
        pos, span = (r["position"] or 0) - 1, sum(o >> 4 for o in ops if OPERATIONS[o & 15] in "MDN=X")
        body = _FIXED.pack(own, pos, len(name), r["mapping_quality"] or 0, _bin(pos, pos + max(1, span)), len(ops), r["flags"] or 0, len(seq), mate, (r.get("mate_position") or 0) - 1, r.get("template_length") or 0)
        body += name + struct.pack(f"<{len(ops)}I", *ops) + bytes(nibbles[i] << 4 | nibbles[i + 1] for i in range(0, len(seq), 2)) + q + _tag_bytes(r.get("tags") or "")
        out += [struct.pack("<i", len(body)), body]
    return blocked(b"".join(out))


def _bin(start: int, end: int) -> int:
    """The smallest bin of the usual index that holds start to end (half open, from 0); for unplaced reads the first of the finest level less one."""
    if start < 0:
        return 4680
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


def sam_header(references: dict[str, int], sorted_by: str = "unsorted") -> list[str]:
    """Header lines of a text file of reads."""
    return [f"@HD\tVN:1.6\tSO:{sorted_by}", *(f"@SQ\tSN:{c}\tLN:{n}" for c, n in references.items())]
