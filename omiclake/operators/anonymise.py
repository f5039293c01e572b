"""Anonymisation transforms of spectra and reads."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from omiclake.operators.analysis import coarsen, mask_below_quantile
from omiclake.operators.projections import reference_span

KEY = ["run_name", "spectrum_index"]


def variant_spectra(identifications: DataFrame) -> DataFrame:
    """Keys of spectra identified with a text that holds SAAV or VARIANT, of any case."""
    text = F.upper("chemical_entity")
    return identifications.where(text.contains("SAAV") | text.contains("VARIANT")).select(*KEY).distinct()


def redact_variants(spectra: DataFrame, identifications: DataFrame) -> DataFrame:
    """Spectra without those of variants; a run with none left has no rows."""
    return spectra.join(variant_spectra(identifications), KEY, "left_anti")


def rare_spectra(identifications: DataFrame, prevalence: DataFrame, threshold: float) -> DataFrame:
    """Keys of spectra that a metabolite of a prevalence under the threshold is identified in; unlisted ones aren't rare."""
    rare = prevalence.where(F.col("prevalence") < threshold).select(F.col("entity").alias("chemical_entity"))
    return identifications.join(rare, "chemical_entity", "left_semi").select(*KEY).distinct()


def mask_rare(spectra: DataFrame, identifications: DataFrame, prevalence: DataFrame, threshold: float) -> DataFrame:
    """Intensities of spectra of rare metabolites become 0.0."""
    hit = rare_spectra(identifications, prevalence, threshold).withColumn("_rare", F.lit(True))
    zero = F.transform("intensity", lambda x: F.lit(0.0))
    return spectra.join(hit, KEY, "left").withColumn("intensity", F.when(F.col("_rare"), zero).otherwise(F.col("intensity"))).drop("_rare")


def keep_identifications(identifications: DataFrame, kept: DataFrame, by_count: bool = True) -> DataFrame:
    """Identifications of spectra that stay: those under the number kept in their run (not renumbered), or by the spectra themselves."""
    if not by_count:
        return identifications.join(kept.select(*KEY), KEY, "left_semi")
    n = kept.groupBy("run_name").agg(F.count("*").alias("_n"))
    return identifications.join(n, "run_name").where(F.col("spectrum_index") < F.col("_n")).drop("_n")


@dataclass(frozen=True)
class Policy:
    redact_saav: bool = False
    quantile: float | None = None
    mz_decimals: int | None = None
    rare_threshold: float | None = None
    strip_metadata: bool = False


def anonymise(spectra: DataFrame, identifications: DataFrame, policy: Policy, prevalence: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Spectra and identifications after the policy. Base peaks stay as they were; identifications are filtered by redaction only."""
    out, ids = spectra, identifications
    if policy.redact_saav:
        out = redact_variants(out, identifications)
        ids = keep_identifications(identifications, out)
    if policy.quantile is not None:
        out = out.withColumn("intensity", mask_below_quantile(F.col("intensity"), policy.quantile))
    if policy.mz_decimals is not None:
        out = out.withColumn("mz", F.transform("mz", lambda x: coarsen(x, policy.mz_decimals)))
    if policy.rare_threshold is not None and prevalence is not None:
        out = mask_rare(out, identifications, prevalence, policy.rare_threshold)
    if policy.strip_metadata and "title" in out.columns:
        out = out.withColumn("title", F.lit(""))
    return out, ids


def counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: spectra redacted, and intensities set to zero in those that stay."""
    pair = before.select(*KEY, F.col("intensity").alias("_old")).join(after.select(*KEY, F.col("intensity").alias("_new")), KEY, "left")
    changed = F.size(F.filter(F.zip_with("_old", "_new", lambda a, b: (a != 0) & (b == 0)), lambda x: x))
    return pair.agg(F.count_if(F.col("_new").isNull()).alias("spectra_redacted"), F.coalesce(F.sum(F.when(F.col("_new").isNotNull(), changed)), F.lit(0)).cast("long").alias("intensities_zeroed"))


def overlaps(position: Column, cigar: Column, start: Column, end: Column) -> Column:
    """Closed overlap of [position, position + span - 1] and [start, end]; without a span the position alone counts."""
    span = reference_span(cigar)
    return (position <= end) & (position + F.greatest(span, F.lit(1)) - 1 >= start)


def read_key(reads: DataFrame) -> list[str]:
    """Ordinals count within a run, so that they name a read together with it; a table of one run may go without its name."""
    return [c for c in ("run_name", "read_index") if c in reads.columns]


def masked_reads(reads: DataFrame, regions: DataFrame, bin_size: int = 1 << 14) -> DataFrame:
    """run_name (where reads have one) and read_index of the reads that overlap a region, once each.

    Both sides meet by bins of the genome. A bin is one row, so that a read meets it once however many regions it holds: the
    starts in it, ascending, each with the largest end so far, bin_size at most. A read finds its last start by halving.
    """
    key = read_key(reads)
    bin_of = lambda x: F.floor(x / bin_size)
    bins = lambda low, high: F.explode(F.sequence(bin_of(low), bin_of(F.greatest(low, high))))
    last = F.col("position") + F.greatest(reference_span(F.col("cigar")), F.lit(1)) - 1
    own = reads.select(*key, "chromosome", "position", last.alias("_last")).select("*", bins(F.col("position"), F.col("_last")).alias("_bin"))
    # A read in a bin ends after its begin: regions that start before it count from there.
    region = regions.where(F.col("end").isNotNull()).select("chromosome", "start", "end", bins(F.col("start"), F.col("end")).alias("_bin"))
    region = region.groupBy("chromosome", "_bin", F.greatest(F.col("start"), F.col("_bin") * bin_size).alias("start")).agg(F.max("end").alias("end"))
    w = Window.partitionBy("chromosome", "_bin").orderBy("start")
    region = region.withColumn("most", F.max("end").over(w)).withColumn("before", F.lag("most").over(w)).where("before IS NULL OR most > before")
    region = region.groupBy("chromosome", "_bin").agg(F.array_sort(F.collect_list(F.struct("start", "most"))).alias("_at"))
    region = region.select("chromosome", "_bin", F.col("_at.start").alias("_starts"), F.col("_at.most").alias("_ends"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bin_size.bit_length()))])
    n = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get("_starts", n + step - 1) <= F.col("_last"), n + step).otherwise(n))
    return own.join(region, ["chromosome", "_bin"]).where(F.get("_ends", n - 1) >= F.col("position")).select(*key).distinct()


def mask_regions(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Sequences (N) and qualities (zero bytes) of overlapping reads are overwritten."""
    hit = masked_reads(reads, regions).withColumn("_hit", F.lit(True))
    out = reads.join(hit, read_key(reads), "left")
    return out.withColumns({
        "sequence": F.when(F.col("_hit"), F.expr("repeat('N', length(sequence))")).otherwise(F.col("sequence")),
        "qualities": F.when(F.col("_hit"), F.expr("unhex(repeat('00', octet_length(qualities)))")).otherwise(F.col("qualities")),
    }).drop("_hit")


def strip_names(reads: DataFrame) -> DataFrame:
    return reads.withColumn("read_name", F.lit(""))


def constant_qualities(reads: DataFrame, value: int = 30) -> DataFrame:
    return reads.withColumn("qualities", F.expr(f"unhex(repeat('{value:02X}', octet_length(qualities)))"))


def seeded_qualities(reads: DataFrame, seed: int) -> DataFrame:
    """Qualities 0 to 93 of a seeded generator, drawn read by read in a run's order: one task for each run."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("read_index")
        rng = np.random.default_rng(seed)
        new = [rng.integers(0, 94, len(q or b""), dtype=np.uint8).tobytes() for q in t["qualities"].to_pylist()]
        return t.set_column(t.schema.get_field_index("qualities"), "qualities", pa.array(new, pa.binary()))

    return reads.groupBy("run_name").applyInArrow(run, reads.schema)
