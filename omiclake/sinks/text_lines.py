"""Lines of text formats as DataFrame columns; write them with df.write.text. Order is a column, never implied."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from omiclake.operators.relations import deduplicated_names
from omiclake.session import stored


def fasta_index(chromosomes: DataFrame, width: int = 60) -> DataFrame:
    """name, length, offset, bases and bytes of a line, in file order by the column ordinal: the usual five index columns."""
    n = F.length("sequence").cast("long")
    head = F.length("name") + 2
    lines = F.floor((n + width - 1) / width)
    w = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    sized = chromosomes.select("ordinal", "name", n.alias("length"), head.alias("_head"), (head + n + lines).cast("long").alias("_bytes"))
    before = F.coalesce(F.sum("_bytes").over(w), F.lit(0))
    return sized.select("name", "length", (before + F.col("_head")).cast("long").alias("offset"), F.lit(width).alias("line_bases"), F.lit(width + 1).alias("line_width"))


def fasta_lines(chromosomes: DataFrame, width: int = 60) -> DataFrame:
    """ordinal and value: a header and the wrapped sequence of each record."""
    wrapped = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    return chromosomes.select("ordinal", F.concat(F.lit(">"), "name", F.lit("\n"), wrapped).alias("value"))


def sam_lines(reads: DataFrame) -> DataFrame:
    """read_index, chromosome, position and value: eleven fields and the tags of each read."""
    star = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "*").otherwise(c)
    mate = F.when(F.col("mate_chromosome").isin("*", ""), "*").when(F.col("mate_chromosome") == F.col("chromosome"), "=").otherwise(F.col("mate_chromosome"))
    has_seq = F.coalesce(F.col("sequence"), F.lit("")) != ""
    blank = F.hex("qualities").rlike("^(FF)*$")
    fields = [
        star(F.col("read_name")), F.col("flags").cast("string"), star(F.col("chromosome")), F.col("position").cast("string"), F.col("mapping_quality").cast("string"), star(F.col("cigar")),
        mate, F.greatest("mate_position", F.lit(0)).cast("string"), F.col("template_length").cast("string"), F.when(has_seq, F.col("sequence")).otherwise("*"),
        F.when(has_seq & ~blank, F.col("qualities").cast("string")).otherwise("*"), F.when(F.coalesce(F.col("tags"), F.lit("")) != "", F.col("tags")),
    ]
    return reads.select("read_index", "chromosome", "position", F.concat_ws("\t", *fields).alias("value"))


def coordinate_sorted(reads: DataFrame) -> DataFrame:
    """By chromosome and position, unplaced reads last, ties by ordinal."""
    return reads.orderBy(F.col("chromosome") == "*", "chromosome", "position", "read_index")


def coordinate_places(reads: DataFrame) -> DataFrame:
    """read_index and place, from 1, of every read in coordinate order; only the partitions' sizes reach the driver."""
    placed = stored(coordinate_sorted(reads).select("read_index", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    before = dict(zip((r["_part"] for r in sizes), accumulate((r["n"] for r in sizes), initial=1)))
    first = F.lit(0) if not before else F.element_at(F.create_map(*(F.lit(x).cast("long") for p in before.items() for x in p)), F.col("_part").cast("long"))
    return placed.select("read_index", (F.col("_id") - F.col("_part").cast("long") * (1 << 33) + first).cast("long").alias("place"))


def fastq_lines(reads: DataFrame, offset: int = 33) -> DataFrame:
    """read_index and value: four lines of each read; 0xFF is quality 0, repeated names carry their ordinal. Needs array<int> qualities."""
    code = F.array_join(F.transform("quality_values", lambda q: F.char(F.when(q == 255, 0).otherwise(q) + offset)), "")
    return deduplicated_names(reads).select("read_index", F.concat(F.lit("@"), "read_name", F.lit("\n"), "sequence", F.lit("\n+\n"), code).alias("value"))


def gfa_lines(parts: dict[str, DataFrame]) -> DataFrame:
    """path, line_no and value of all parts, in the order they had."""
    tail = lambda: F.concat(*[F.when(F.size("tags") > 0, F.concat(F.lit("\t"), F.array_join("tags", "\t"))).otherwise("")])
    s = parts["segments"].select("path", "line_no", F.concat(F.concat_ws("\t", F.lit("S"), "name", F.coalesce("sequence", F.lit("*"))), tail()).alias("value"))
    n = parts["links"].select("path", "line_no", F.concat(F.concat_ws("\t", F.lit("L"), "source", "source_orient", "target", "target_orient", "overlap"), tail()).alias("value"))
    p = parts["paths"].select("path", "line_no", F.concat(F.concat_ws("\t", F.lit("P"), "name", F.array_join("steps", ","), "overlaps"), tail()).alias("value"))
    return s.unionByName(n).unionByName(p).unionByName(parts["other"].select("path", "line_no", "value")).orderBy("path", "line_no")


def isa_assays(runs: DataFrame, chromatograms: DataFrame) -> DataFrame:
    """An assay for each run; its derived-file cell lists the run's chromatograms, joined by ';' in order."""
    names = chromatograms.groupBy("run_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]), ";").alias("derived_files"))
    return runs.join(names, "run_name", "left").select("run_name", F.coalesce("derived_files", F.lit("")).alias("derived_files"))
