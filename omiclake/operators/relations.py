"""Lookups between tables: runs, samples, features, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs_for_sample(runs: DataFrame, provenance: DataFrame, sample_uri: str) -> DataFrame:
    """Runs with a provenance record that names the sample among its inputs, once each."""
    return runs.join(provenance.where(F.array_contains("input_refs", sample_uri)).select("run_name"), "run_name", "left_semi")


def all_runs(*by_priority: DataFrame) -> DataFrame:
    """Runs of all modalities by name; of equal names the first table's holds."""
    rows = reduce(DataFrame.unionByName, [d.withColumn("_p", F.lit(i)) for i, d in enumerate(by_priority)])
    first = Window.partitionBy("run_name").orderBy("_p")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_p", "_n")


def orphan_samples(samples: DataFrame, subjects: DataFrame) -> DataFrame:
    """Samples that name a subject which isn't there; the sentinels '' and 0 name none."""
    named = samples.where(F.col("subject_id").isNotNull() & ~F.col("subject_id").cast("string").isin("", "0"))
    return named.join(subjects.select("subject_id"), "subject_id", "left_anti")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def interned(df: DataFrame, name: str, order: str) -> DataFrame:
    """name and id: dense, from 0, in the order of first appearance; '*' and '' have 65535. Names fit one task, rows needn't."""
    none = F.col(name).isin("*", "")
    first = df.where(~none).groupBy(name).agg(F.min(order).alias("_first"))
    ids = first.select(name, (F.row_number().over(Window.orderBy("_first", name)) - 1).alias("id"))
    return ids.unionByName(df.where(none).select(name).distinct().withColumn("id", F.lit(65535)))


def backfill(features: DataFrame, evidence: DataFrame) -> DataFrame:
    """Features whose entity is the placeholder of an evidence row get that row's entity."""
    e = evidence.groupBy("sme_id").agg(F.min_by("chemical_entity", "rank").alias("_entity"))
    out = features.join(e, features["chemical_entity"] == e["sme_id"], "left")
    return out.withColumn("chemical_entity", F.coalesce("_entity", "chemical_entity")).drop("sme_id", "_entity")


def rank_confidence(rank: Column) -> Column:
    """1 / rank; an absent or zero rank counts as 1."""
    return 1.0 / F.when(F.coalesce(rank, F.lit(0)) == 0, F.lit(1)).otherwise(rank)


def unpivoted(df: DataFrame, keys: list[str], columns: dict[str, str], labels: DataFrame) -> DataFrame:
    """keys, sample_ref and abundance of each assay column that isn't null; labels: assay and sample_ref, the assay itself without one."""
    rows = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("assay"), F.col(c).cast("double").alias("abundance")) for a, c in columns.items()])).alias("_x"))
    rows = rows.select(*keys, "_x.*").where("abundance IS NOT NULL").join(labels, "assay", "left")
    return rows.select(*keys, F.coalesce("sample_ref", "assay").alias("sample_ref"), "abundance")


def pivoted(quantifications: DataFrame, samples: list[str]) -> DataFrame:
    """A row for each entity, a column for each sample: the last abundance by ordinal."""
    return quantifications.groupBy("chemical_entity").pivot("sample_ref", samples).agg(F.max_by("abundance", "ordinal"))


def best_confidence(identifications: DataFrame, quantifications: DataFrame) -> DataFrame:
    """chemical_entity, confidence (the best, 0 at least) and quantified, of entities of either table."""
    best = identifications.groupBy("chemical_entity").agg(F.max("confidence_score").alias("best"))
    have = quantifications.select("chemical_entity").distinct().withColumn("quantified", F.lit(True))
    return best.join(have, "chemical_entity", "full").select("chemical_entity", F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)).alias("confidence"), F.coalesce("quantified", F.lit(False)).alias("quantified"))


def concat_runs(parts: list[DataFrame], order: str = "read_index") -> DataFrame:
    """Parts one after another, ordinals anew from 0; missing tags are empty where any part has tags."""
    tags = any("tags" in p.columns for p in parts)
    fix = lambda p: p if not tags else p.withColumn("tags", F.coalesce(F.col("tags"), F.lit(""))) if "tags" in p.columns else p.withColumn("tags", F.lit(""))
    rows = reduce(DataFrame.unionByName, [fix(p).withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    sizes = rows.groupBy("_part").agg((F.max(order) + 1).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(before), "_part").withColumn(order, F.col(order) + F.col("_before")).drop("_part", "_before")


def slice_run(run: DataFrame, start: int, stop: int, order: str = "read_index") -> DataFrame:
    return run.where((F.col(order) >= start) & (F.col(order) < stop)).withColumn(order, F.col(order) - start)


def sequence_errors(units: DataFrame) -> DataFrame:
    """Units whose sequence isn't above the one before, by arrival within a dataset; gaps are legal."""
    w = Window.partitionBy("dataset_id").orderBy("arrival")
    return units.withColumn("before", F.lag("au_sequence").over(w)).where("au_sequence <= before")


def carried_precursor(spectra: DataFrame) -> DataFrame:
    """Second-level spectra get the base-peak m/z of the last first-level one before them, 0 without one."""
    w = Window.partitionBy("run_name").orderBy("spectrum_index").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("ms_level") == 1, F.col("base_peak_mz")), True).over(w)
    return spectra.withColumn("precursor_mz", F.when(F.col("ms_level") == 2, F.coalesce(last, F.lit(0.0))).otherwise(F.lit(0.0)))


def deduplicated_names(reads: DataFrame, name: str = "read_name", order: str = "read_index") -> DataFrame:
    """From its second appearance on, a name carries '#' and the read's ordinal."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return reads.withColumn(name, F.when(n > 1, F.concat(F.col(name), F.lit("#"), F.col(order).cast("string"))).otherwise(F.col(name)))
