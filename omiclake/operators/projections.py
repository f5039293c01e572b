"""Derived columns and the fixed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from omiclake.operators.filters import GENOMIC_CLASS


def with_offsets(index: DataFrame, run: str = "run_name", order: str = "spectrum_index", length: str = "length") -> DataFrame:
    """offset: the exclusive running sum of length within a run."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def base_peak(intensity: Column) -> Column:
    """Largest intensity; 0.0 of an empty or absent array."""
    return F.coalesce(F.array_max(intensity), F.lit(0.0))


def reference_span(cigar: Column) -> Column:
    """Summed lengths of M, D, N, = and X; 0 of an empty, '*' or malformed text."""
    parts = F.transform(F.regexp_extract_all(cigar, F.lit(r"([0-9]+)[MDN=X]"), F.lit(1)), lambda x: x.cast("long"))
    return F.when(cigar.rlike(r"^([0-9]+[MIDNSHP=X])+$"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))


def wire_polarity(stored: Column) -> Column:
    return F.when(stored == 1, 0).when(stored == -1, 1).otherwise(2)


def stored_polarity(wire: Column) -> Column:
    return F.when(wire == 0, 1).when(wire == 1, -1).otherwise(0)


def unit_stats(units: DataFrame) -> DataFrame:
    """Channel count, elements and payload bytes of each access unit; genomic columns only for genomic units."""
    total = lambda name: F.aggregate("channels", F.lit(0).cast("long"), lambda a, c: a + c[name].cast("long"))
    genomic = F.col("spectrum_class") == GENOMIC_CLASS
    return units.select(
        "dataset_id", "au_sequence", "spectrum_class", F.size("channels").alias("channel_count"), total("n_elements").alias("total_elements"),
        F.aggregate("channels", F.lit(0).cast("long"), lambda a, c: a + F.octet_length(c["data"])).alias("payload_bytes"),
        F.when(genomic, F.col("chromosome")).alias("chromosome"), F.when(genomic, F.col("position")).alias("position"),
        F.when(~genomic, F.col("retention_time")).alias("retention_time"),
    )


def spectrum_units(spectra: DataFrame, dataset_id: Column, index: DataFrame | None = None) -> DataFrame:
    """Access-unit headers of spectra; ion mobility is 0.0 in files."""
    return spectra.select(
        dataset_id.alias("dataset_id"), F.col("spectrum_index").alias("au_sequence"), F.lit(0).alias("spectrum_class"), "ms_level",
        wire_polarity(F.col("polarity")).alias("polarity"), "retention_time", "precursor_mz", "precursor_charge",
        F.lit(0.0).alias("ion_mobility"), "base_peak_intensity", F.lit("").alias("chromosome"), F.lit(0).cast("long").alias("position"),
    )


def read_units(reads: DataFrame, dataset_id: Column) -> DataFrame:
    """Access-unit headers of reads, class 5; flags keep their low 16 bits."""
    return reads.select(
        dataset_id.alias("dataset_id"), F.col("read_index").alias("au_sequence"), F.lit(GENOMIC_CLASS).alias("spectrum_class"),
        "chromosome", "position", "mapping_quality", F.col("flags").bitwiseAND(F.lit(0xFFFF)).alias("flags"),
    )


def manifest(index: DataFrame, run: str = "run_name") -> DataFrame:
    """Spectra of each run in all and by MS level (a map)."""
    levels = index.groupBy(run, "ms_level").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("ms_level", "n")))
    return levels.groupBy(run).agg(F.sum("n").alias("spectrum_count"), F.map_from_entries(entries).alias("ms_level_distribution"))


def pixel_rows(images: DataFrame, kind: str = "cube") -> DataFrame:
    """Rows of a height x width x points cube, row-major: x the column, y the row, z 1."""
    rows = images.select("*", F.posexplode(kind).alias("y", "_row")).drop(kind)
    return rows.select("*", F.posexplode("_row").alias("x", "intensity")).drop("_row").withColumn("z", F.lit(1))


def sorted_json(attributes: Column) -> Column:
    """A map as compact JSON with sorted keys; {} of an empty or absent one."""
    entries = F.array_sort(F.map_entries(attributes))
    return F.coalesce(F.to_json(F.map_from_entries(entries)), F.lit("{}"))


def tag_map(tags: Column) -> Column:
    """A read's tab-joined tags as a map of key to TYPE:value."""
    parts = F.filter(F.split(tags, "\t"), lambda t: F.length(t) >= 5)
    return F.map_from_entries(F.transform(parts, lambda t: F.struct(t.substr(1, 2), t.substr(F.lit(4), F.length(t)))))


def packable_fraction(sequence: Column) -> Column:
    """Share of upper-case A, C, G and T; 1.0 of an empty text."""
    return F.when(F.length(sequence) == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(sequence, "[^ACGT]", "")) / F.length(sequence))


def reference_md5(chromosomes: DataFrame, key: str = "uri") -> DataFrame:
    """MD5 of a reference's sequences joined in the order of chromosome names, and its number of bases."""
    parts = F.array_sort(F.collect_list(F.struct("name", "sequence")))
    return chromosomes.groupBy(key).agg(F.md5(F.array_join(F.transform(parts, lambda p: p["sequence"]), "")).alias("md5"), F.sum(F.length("sequence")).alias("total_bases"))


def block_islands(reads: DataFrame, cap: int, run: str = "run_name") -> DataFrame:
    """block: reads in order, cut where the chromosome changes and every cap reads; ids ascend within a run from 0."""
    w = Window.partitionBy(run).orderBy("read_index")
    change = F.coalesce((F.col("chromosome") != F.lag("chromosome").over(w)).cast("int"), F.lit(0))
    rows = reads.withColumn("_change", change).withColumn("_island", F.sum("_change").over(w))
    place = F.row_number().over(Window.partitionBy(run, "_island").orderBy("read_index")) - 1
    rows = rows.withColumn("_cut", ((place % cap == 0) & ((F.col("_island") > 0) | (place > 0))).cast("int"))
    return rows.withColumn("block", F.sum("_cut").over(w)).drop("_change", "_island", "_cut")


def block_of(reads: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each read's block: read_start <= read_index < read_start + n_reads. An as-of lookup by one sort, no range join."""
    ends = blocks.select("run_name", F.col("read_start").alias("_at"), F.struct("block", "read_start", "n_reads").alias("_block"), F.lit(None).cast("long").alias("read_index"))
    own = reads.select("run_name", F.col("read_index").alias("_at"), F.lit(None).cast(ends.schema["_block"].dataType).alias("_block"), "read_index")
    w = Window.partitionBy("run_name").orderBy("_at", F.col("read_index").isNotNull())
    found = own.unionByName(ends).withColumn("_last", F.last("_block", True).over(w)).where("read_index IS NOT NULL")
    inside = F.col("read_index") < F.col("_last.read_start") + F.col("_last.n_reads")
    return found.select("run_name", "read_index", F.when(inside, F.col("_last.block")).alias("block"))


def walk_order(units: DataFrame) -> DataFrame:
    """Stream order: spectral datasets before genomic ones, then by dataset and sequence."""
    return units.orderBy((F.col("spectrum_class") == GENOMIC_CLASS).cast("int"), "dataset_id", "au_sequence")
