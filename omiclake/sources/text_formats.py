"""Readers of line formats: FASTA, FASTQ, SAM text, GFA, mzTab, JCAMP-DX. Files are read by Spark, so any store it knows will do.

FASTA and FASTQ split within a file (records begin at a separator); GFA and mzTab need a file's line
order, which comes from the whole file's text, one task for each file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from omiclake.session import stored

READ = (
    "run_name string, read_index bigint, read_name string, chromosome string, position bigint, mapping_quality int, cigar string, sequence string,"
    " qualities binary, flags bigint, mate_chromosome string, mate_position bigint, template_length int, tags string"
)
#: Texts that mean "missing" in mzTab cells.
MISSING = ("", "null", "na", "n/a", "nan")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path and value: each file's whole text, unzipped where its name ends in .gz."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (first word of the header) and sequence of each record; sequence before a header, or no record at all, raises."""
    return _fasta(spark.read.option("lineSep", "\n>").text(path)).drop("path", "place")


def _fasta(rows: DataFrame) -> DataFrame:
    more = [c for c in ("path", "place") if c in rows.columns]
    lines = rows.select(F.regexp_replace("value", "\r", "").alias("v"), *more)
    body = F.regexp_replace(F.col("v"), "^>", "")
    head = F.split(body, "\n", 2)
    bad = F.when((F.trim(F.col("v")) != "") & (F.trim(head[0]) == ""), F.raise_error(F.lit("a FASTA record needs a name")).cast("string"))
    name = F.coalesce(bad, F.regexp_extract(head[0], r"^(\S+)", 1))
    return lines.where(F.trim(F.col("v")) != "").select(name.alias("name"), F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"\s", "").alias("sequence"), *more)


def placed(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """value, path and place of each line of text files (split by Spark): places count from 0 in each file, in its order.

    A part of a file is read by one task from its first line on, so that only the parts' counts need be summed.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    rows = stored(rows)
    parts = rows.groupBy("path", "_start").agg(F.min("_id").alias("_low"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("path", "_start", "_low", before.alias("_before"))
    return rows.join(parts, ["path", "_start"]).select("value", "path", (F.col("_id") - F.col("_low") + F.col("_before")).alias("place"))


def dense(rows: DataFrame, name: str) -> DataFrame:
    """rows with a column that numbers them from 0 without gaps, by path and place where they have them, else by their partitions.

    Only a count of rows for each file or task reaches the driver.
    """
    spark, by_file = rows.sparkSession, "place" in rows.columns and "path" in rows.columns
    rows = stored(rows if by_file else rows.withColumn("_id", F.monotonically_increasing_id()))
    part = F.col("path") if by_file else F.shiftright("_id", 33)
    total, starts = 0, []
    for r in rows.groupBy(part.alias("p")).count().orderBy("p").collect():
        starts.append((r["p"], total))
        total += r["count"]
    known = F.broadcast(spark.createDataFrame(starts, f"_p {'string' if by_file else 'bigint'}, _first bigint"))
    inside = (F.row_number().over(Window.partitionBy("path").orderBy("place")) - 1) if by_file else F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.withColumn("_in", inside).join(known, part == F.col("_p"))
    return out.withColumn(name, F.col("_first") + F.col("_in")).drop("_id", "_p", "_first", "_in")


def fastq_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal (within the file), name, sequence and qualities of four-line records, of files that Spark splits anywhere.

    A record is four lines by their places in the file, wherever it is cut; lines that don't make records, and unequal
    lengths, raise. Blank lines may only end a file.
    """
    lines = placed(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    at = lambda k: F.max(F.when(F.col("place") % 4 == k, F.col("value")))
    rows = lines.groupBy("path", F.floor(F.col("place") / 4).alias("ordinal")).agg(*[at(k).alias(f"l{k}") for k in range(4)])
    rows = rows.where(F.concat_ws("", "l0", "l1", "l2", "l3") != "")
    good = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3"))
    said = F.concat(F.col("path"), F.lit(": record "), F.col("ordinal").cast("string"), F.lit(" isn't a FASTQ record"))
    name = F.when(F.coalesce(good, F.lit(False)), F.regexp_extract("l0", r"^@(\S*)", 1)).otherwise(F.raise_error(said).cast("string"))
    return rows.select("path", "ordinal", name.alias("name"), F.col("l1").alias("sequence"), F.col("l3").cast("binary").alias("qualities"))


def fasta_reads(spark: SparkSession, path: str, run_name: str = "run") -> DataFrame:
    """FASTA records as unaligned reads: flags 4, chromosome '*', position 0, mapping quality 255, qualities 0xFF."""
    rows = dense(_fasta(placed(spark, path, "\n>")), "read_index")
    return rows.select(
        F.lit(run_name).alias("run_name"), "read_index", F.col("name").alias("read_name"), F.lit("*").alias("chromosome"),
        F.lit(0).cast("long").alias("position"), F.lit(255).alias("mapping_quality"), F.lit("*").alias("cigar"), "sequence",
        F.expr("unhex(repeat('FF', length(sequence)))").alias("qualities"), F.lit(4).cast("long").alias("flags"),
    )


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal (within the file), name, sequence and qualities (bytes as in the file) of four-line records.

    Blank lines between records are skipped; a text that isn't a record, or unequal lengths, raise. A file is one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines, at, out = text.replace("\r", "").split("\n"), 0, []
                while at < len(lines):
                    if not lines[at]:
                        at += 1
                        continue
                    head, seq, plus, qual = (*lines[at : at + 4], "", "", "")[:4]
                    if head[0] != "@" or plus[:1] != "+" or len(seq) != len(qual):
                        raise ValueError(f"{path}: line {at + 1} doesn't begin a FASTQ record")
                    out.append((path, len(out), head[1:].split()[0] if head[1:].split() else "", seq, qual.encode("latin-1")))
                    at += 4
                for i in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(("path", "ordinal", "name", "sequence", "qualities"), r, strict=True)) for r in out[i : i + 10_000]], FASTQ)

    return whole_files(spark, path).mapInArrow(run, "path string, ordinal bigint, name string, sequence string, qualities binary")


FASTQ = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("name", pa.string()), ("sequence", pa.string()), ("qualities", pa.binary())])


def sam(lines: DataFrame, run_name: str = "run", ordinal: Column | None = None) -> DataFrame:
    """Reads of SAM lines (column value); header lines go. RNEXT '=' is the read's own, SEQ '*' empty, QUAL '*' 0xFF bytes."""
    c = F.split("value", "\t", 12)
    f = lambda i: F.get(c, F.lit(i))
    seq = F.when(f(9) == "*", "").otherwise(f(9))
    rows = lines.where(~F.col("value").startswith("@") & (F.col("value") != ""))
    rows = dense(rows, "_ordinal") if ordinal is None else rows.withColumn("_ordinal", ordinal)
    return rows.select(
        F.lit(run_name).alias("run_name"), F.col("_ordinal").alias("read_index"), f(0).alias("read_name"), f(2).alias("chromosome"),
        f(3).cast("long").alias("position"), f(4).cast("int").alias("mapping_quality"), f(5).alias("cigar"), seq.alias("sequence"),
        F.when(f(10) == "*", F.unhex(F.repeat(F.lit("FF"), F.length(seq)))).otherwise(f(10).cast("binary")).alias("qualities"), f(1).cast("long").alias("flags"),
        F.when(f(6) == "=", f(2)).otherwise(f(6)).alias("mate_chromosome"), f(7).cast("long").alias("mate_position"), f(8).cast("int").alias("template_length"), F.coalesce(f(11), F.lit("")).alias("tags"),
    )


def numbered_lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 0) and value of each line of whole files."""
    return files.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def gfa(lines: DataFrame) -> dict[str, DataFrame]:
    """segments, links, paths and other lines of numbered lines; lines with too few fields are kept as other."""
    c = F.split("value", "\t")
    kind = F.when((c[0] == "S") & (F.size(c) >= 3), "S").when((c[0] == "L") & (F.size(c) >= 6), "L").when((c[0] == "P") & (F.size(c) >= 4), "P").otherwise("")
    rows = lines.withColumn("_c", c).withColumn("_kind", kind)
    f = lambda i: F.get("_c", F.lit(i))
    rest = lambda i: F.slice("_c", F.lit(i), F.greatest(F.size("_c") - i + 1, F.lit(0))).alias("tags")
    own = lambda k: rows.where(F.col("_kind") == k)
    return {
        "segments": own("S").select("path", "line_no", f(1).alias("name"), F.when(f(2) != "*", f(2)).alias("sequence"), rest(4)),
        "links": own("L").select("path", "line_no", f(1).alias("source"), f(2).alias("source_orient"), f(3).alias("target"), f(4).alias("target_orient"), f(5).alias("overlap"), rest(7)),
        "paths": own("P").select("path", "line_no", f(1).alias("name"), F.split(f(2), ",").alias("steps"), f(3).alias("overlaps"), rest(5)),
        "other": own("").select("path", "line_no", "value"),
    }


def number(c: Column) -> Column:
    """A cell as a double; null of a missing or malformed one."""
    return F.when(~F.lower(F.trim(c)).isin(*MISSING), F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double"))


def mztab_section(lines: DataFrame, prefix: str, header: str) -> DataFrame:
    """path, line_no and cells (map of column name to text) of a section's rows; each file's own header names them."""
    heads = lines.where(F.col("value").startswith(header + "\t")).select("path", F.split("value", "\t").alias("_head"))
    rows = lines.where(F.col("value").startswith(prefix + "\t")).select("path", "line_no", F.split("value", "\t").alias("_row"))
    return rows.join(heads, "path").select("path", "line_no", F.map_from_arrays(F.slice("_head", F.lit(2), F.size("_head") - 1), F.slice("_row", F.lit(2), F.size("_head") - 1)).alias("cells"))


def mztab_runs(lines: DataFrame) -> DataFrame:
    """path, run number and name: of a location its last part without extension, else run_N."""
    meta = lines.where(F.col("value").rlike("^MTD\tms_run\\[[0-9]+\\]-location\t"))
    c = F.split("value", "\t")
    name = F.regexp_replace(F.element_at(F.split(c[2], "/"), -1), r"\.[^.]*$", "")
    at = F.regexp_extract(c[1], r"\[([0-9]+)\]", 1)
    return meta.select("path", at.cast("int").alias("ms_run"), F.when(name != "", name).otherwise(F.concat(F.lit("run_"), at)).alias("run_name"))


def mztab_identifications(lines: DataFrame) -> DataFrame:
    """PSM rows: entity (accession, else sequence), best score (0 at least), run name and spectrum index."""
    rows = mztab_section(lines, "PSM", "PSH")
    cell = lambda k: F.element_at("cells", F.lit(k))
    scores = F.transform(F.filter(F.map_entries("cells"), lambda e: e["key"].startswith("search_engine_score")), lambda e: F.coalesce(number(e["value"]), F.lit(0.0)))
    entity = F.when(F.coalesce(F.lower(cell("accession")), F.lit("null")) != "null", cell("accession")).otherwise(cell("sequence"))
    ms_run, at = F.regexp_extract(cell("spectra_ref"), r"ms_run\[([0-9]+)\]", 1), F.regexp_extract(cell("spectra_ref"), r"(?:index|scan|spectrum)=([0-9]+)", 1)
    rows = rows.select("path", "line_no", entity.alias("chemical_entity"), F.greatest(F.coalesce(F.array_max(scores), F.lit(0.0)), F.lit(0.0)).alias("confidence_score"), F.when(ms_run != "", ms_run.try_cast("int")).alias("ms_run"), F.coalesce(at.try_cast("long"), F.lit(0)).alias("spectrum_index"))
    return rows.join(mztab_runs(lines), ["path", "ms_run"], "left").select("path", "line_no", F.coalesce("run_name", F.concat(F.lit("run_"), F.coalesce(F.col("ms_run").cast("string"), F.lit("1")))).alias("run_name"), "spectrum_index", "chemical_entity", "confidence_score")


#: The digits of the squeezed, difference and duplicate forms of JCAMP-DX.
SQUEEZED = {c: i for i, c in enumerate("@ABCDEFGHI")} | {c: -i - 1 for i, c in enumerate("abcdefghi")}
DIFFERENCE = {c: i for i, c in enumerate("%JKLMNOPQR")} | {c: -i - 1 for i, c in enumerate("jklmnopqr")}
DUPLICATE = {c: i + 1 for i, c in enumerate("STUVWXYZs")}
_TOKEN = re.compile(r"[@A-Ia-i%J-Rj-rS-Zs][0-9]*|[+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?")


def jcamp_values(lines: list[str]) -> list[float]:
    """Ordinates of (X++(Y..Y)) lines in any of the packed forms; a line's first number is its abscissa.

    After a line that ends in a difference the next begins with that last value again, as a check, which goes.
    """
    out: list[float] = []
    check = False
    for line in lines:
        tokens = _TOKEN.findall(line.split("$$")[0])
        if not tokens:
            continue
        last, step, kind, first = 0.0, 0.0, "", True
        for t in tokens[1:]:
            c, digits = t[0], t[1:]
            if c in DUPLICATE:
                for _ in range(int(f"{DUPLICATE[c]}{digits}") - 1):
                    last = last + step if kind == "difference" else last
                    out.append(last)
                continue
            if c in DIFFERENCE:
                sign = -1 if c.islower() else 1
                step, kind = sign * float(f"{abs(DIFFERENCE[c])}{digits}"), "difference"
                last += step
            elif c in SQUEEZED:
                last, kind = (-1 if c.islower() else 1) * float(f"{abs(SQUEEZED[c])}{digits}"), "squeezed"
            else:
                last, kind = float(t), "plain"
            if first and check and out and abs(last - out[-1]) <= 1e-9:
                first = False
                continue
            first = False
            out.append(last)
        check = kind == "difference"
    return out


def jcamp(files: DataFrame) -> DataFrame:
    """path, title, data_type, x and y of JCAMP-DX documents: labelled records, then packed ordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head, body = {}, None
                for line in text.replace("\r", "").split("\n"):
                    if line.startswith("##"):
                        k, _, v = line[2:].partition("=")
                        k = re.sub(r"[ \-/_]", "", k).upper()
                        if k == "END":
                            break
                        head[k], body = v.split("$$")[0].strip(), [] if k == "XYDATA" else None
                    elif body is not None:
                        body.append(line)
                        head["_BODY"] = body
                y = np.array(jcamp_values(head.get("_BODY", []))) * float(head.get("YFACTOR", 1))
                n = len(y)
                x0, x1 = float(head.get("FIRSTX", 0)), float(head.get("LASTX", n - 1))
                step = float(head["DELTAX"]) if "DELTAX" in head else (x1 - x0) / (n - 1) if n > 1 else 0.0
                rows.append({"path": path, "title": head.get("TITLE", ""), "data_type": head.get("DATATYPE", ""), "x": (x0 + np.arange(n) * step).tolist(), "y": y.tolist()})
            yield pa.RecordBatch.from_pylist(rows, JCAMP)

    return files.mapInArrow(run, "path string, title string, data_type string, x array<double>, y array<double>")


JCAMP = pa.schema([("path", pa.string()), ("title", pa.string()), ("data_type", pa.string()), ("x", pa.list_(pa.float64())), ("y", pa.list_(pa.float64()))])
