"""mzTab sections as tables, and tables as an mzTab document. Lines come with path, line_no and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omiclake.operators.relations import rank_confidence
from omiclake.sources.text_formats import mztab_section, number

#: Sections with their header rows, and how their abundance columns begin.
SECTIONS = {"PRT": ("PRH", "protein_abundance_assay"), "PEP": ("PEH", "peptide_abundance_assay"), "SML": ("SMH", "abundance_study_variable"), "SMF": ("SFH", "abundance_assay"), "SME": ("SEH", "")}


def cell(name: str) -> Column:
    """A named cell; null where it is absent, empty or the word null."""
    c = F.trim(F.element_at("cells", F.lit(name)))
    return F.when(F.lower(c).isin("", "null"), F.lit(None)).otherwise(c)


def sample_labels(lines: DataFrame) -> DataFrame:
    """path, kind (assay or study_variable), at and sample_ref, of the metadata rows that name them."""
    c = F.split("value", "\t")
    meta = lines.where(F.col("value").startswith("MTD\t")).select("path", c[1].alias("k"), c[2].alias("v"))
    pattern = r"^(assay|study_variable)\[([0-9]+)\](?:-(?:sample_ref|description))?$"
    named = meta.select("path", F.regexp_extract("k", pattern, 1).alias("kind"), F.regexp_extract("k", pattern, 2).alias("at"), "k", "v").where("kind != ''")
    best = F.max_by("v", F.when(F.col("k").contains("-"), 1).otherwise(0))
    return named.groupBy("path", "kind", F.col("at").cast("int").alias("at")).agg(best.alias("sample_ref"))


def abundances(lines: DataFrame, section: str) -> DataFrame:
    """path, line_no, cells, sample_ref and abundance of a section: a row for each abundance that isn't null, by its sample's label."""
    header, start = SECTIONS[section]
    entries = F.filter(F.map_entries("cells"), lambda e: e["key"].rlike(rf"^{start}\[[0-9]+\]$"))
    rows = mztab_section(lines, section, header).select("path", "line_no", "cells", F.explode(entries).alias("_e"))
    rows = rows.select("path", "line_no", "cells", F.regexp_extract("_e.key", r"\[([0-9]+)\]", 1).cast("int").alias("at"), number(F.col("_e.value")).alias("abundance")).where("abundance IS NOT NULL")
    kind = "study_variable" if start.endswith("study_variable") else "assay"
    labels = sample_labels(lines).where(F.col("kind") == kind).drop("kind")
    out = rows.join(labels, ["path", "at"], "left")
    return out.select("path", "line_no", "cells", F.coalesce("sample_ref", F.concat(F.lit(f"{kind}_"), F.col("at").cast("string"))).alias("sample_ref"), "abundance")


def protein_quantities(lines: DataFrame) -> DataFrame:
    """Of PRT rows: path, line_no, chemical_entity (the accession), sample_ref and abundance; rows without accession go."""
    return abundances(lines, "PRT").select("path", "line_no", cell("accession").alias("chemical_entity"), "sample_ref", "abundance").where("chemical_entity IS NOT NULL")


def _molecule() -> Column:
    return F.coalesce(cell("database_identifier"), cell("chemical_name"), cell("chemical_formula"))


def _evidence(entity: Column) -> Column:
    parts = [F.when(cell(c) != entity, F.concat(F.lit(f"{k}="), cell(c))) for k, c in (("name", "chemical_name"), ("formula", "chemical_formula"))]
    return F.array_compact(F.array(*parts))


def small_molecules(lines: DataFrame) -> DataFrame:
    """Of SML rows: identifications of the run metabolomics, with name and formula as evidence where they aren't the entity itself."""
    rows = mztab_section(lines, "SML", "SMH").withColumn("chemical_entity", _molecule()).where("chemical_entity IS NOT NULL")
    score = F.coalesce(number(F.element_at("cells", F.lit("best_id_confidence_value"))), F.lit(0.0))
    return rows.select("path", "line_no", F.lit("metabolomics").alias("run_name"), F.lit(0).cast("long").alias("spectrum_index"), "chemical_entity", score.alias("confidence_score"), _evidence(F.col("chemical_entity")).alias("evidence_chain"))


def molecule_quantities(lines: DataFrame) -> DataFrame:
    """Of SML rows: path, line_no, chemical_entity, sample_ref and abundance by study variable."""
    return abundances(lines, "SML").select("path", "line_no", _molecule().alias("chemical_entity"), "sample_ref", "abundance").where("chemical_entity IS NOT NULL")


def features(lines: DataFrame, section: str) -> DataFrame:
    """Of PEP or SMF rows: feature_id, chemical_entity, exp_mz, charge, retention_time, adduct and abundances (a map by sample).

    A peptide is named by its sequence, else its accession. A small molecule's feature holds the id of its first evidence
    row for a placeholder, which relations.backfill turns into that row's entity.
    """
    header, _ = SECTIONS[section]
    got = abundances(lines, section).groupBy("path", "line_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sample_ref", "abundance")))).alias("abundances"))
    rows = mztab_section(lines, section, header).join(got, ["path", "line_no"], "left")
    small = section == "SMF"
    entity = F.trim(F.get(F.split(cell("SME_ID_REFS"), r"\|"), F.lit(0))) if small else F.coalesce(cell("sequence"), cell("accession"))
    return rows.select(
        "path", "line_no", (cell("SMF_ID") if small else F.col("line_no").cast("string")).alias("feature_id"), entity.alias("chemical_entity"),
        number(cell("exp_mass_to_charge" if small else "mass_to_charge")).alias("exp_mz"), number(cell("charge")).cast("int").alias("charge"),
        number(F.get(F.split(cell("retention_time_in_seconds" if small else "retention_time"), r"\|"), F.lit(0))).alias("retention_time"), cell("adduct_ion").alias("adduct"),
        F.coalesce("abundances", F.create_map().cast("map<string,double>")).alias("abundances"),
    )


def evidence(lines: DataFrame) -> DataFrame:
    """Of SME rows: sme_id, chemical_entity, rank, confidence_score (1 / rank), spectra_ref and evidence_chain."""
    rank = number(cell("rank")).cast("int")
    rows = mztab_section(lines, "SME", "SEH").withColumn("chemical_entity", _molecule()).where("chemical_entity IS NOT NULL")
    return rows.select("path", "line_no", cell("SME_ID").alias("sme_id"), "chemical_entity", rank.alias("rank"), rank_confidence(rank).alias("confidence_score"), cell("spectra_ref").alias("spectra_ref"), _evidence(F.col("chemical_entity")).alias("evidence_chain"))


def _cell(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def short(c: Column) -> Column:
    """A number in six significant digits, without trailing zeros, in powers of ten where it is long; null as the word."""

    @F.pandas_udf("string")
    def text(x):
        return x.map(lambda v: "null" if v is None or v != v else f"{v:g}")

    return text(c.cast("double"))


def document_lines(identifications: DataFrame, quantifications: DataFrame, title: str = "") -> DataFrame:
    """ordinal and value: an mzTab document's lines, to be written in that order.

    identifications: ordinal, run_name, spectrum_index, chemical_entity, confidence_score; quantifications: ordinal,
    chemical_entity, sample_ref, abundance. Runs and samples are numbered as they are first met, a sample without a name
    is called sample; entities have one row each, as first met, with the last abundance of each sample.
    Only the names of runs and samples reach the driver.
    """
    spark = identifications.sparkSession
    first = lambda df, c: [r[0] for r in df.groupBy(c).agg(F.min("ordinal").alias("o")).orderBy("o").select(c).collect()]
    named = quantifications.withColumn("sample_ref", F.when(F.coalesce("sample_ref", F.lit("")) == "", "sample").otherwise(F.col("sample_ref")))
    runs, samples = first(identifications, "run_name"), first(named, "sample_ref")
    head = ["MTD\tmzTab-version\t1.0", "MTD\tmzTab-mode\tSummary", "MTD\tmzTab-type\tQuantification", f"MTD\tdescription\t{title}"]
    head += [f"MTD\tms_run[{k}]-location\tfile://{r}" for k, r in enumerate(runs, 1)]
    head += [f"MTD\tassay[{k}]-sample_ref\t{s}" for k, s in enumerate(samples, 1)]
    lines = spark.createDataFrame([(0, k, x) for k, x in enumerate(head)], "section int, o bigint, value string")
    if samples:
        header = "PRH\taccession\t" + "\t".join(f"protein_abundance_assay[{k}]" for k in range(1, len(samples) + 1))
        wide = named.groupBy("chemical_entity").pivot("sample_ref", samples).agg(F.max_by("abundance", "ordinal"))
        wide = wide.join(named.groupBy("chemical_entity").agg(F.min("ordinal").alias("o")), "chemical_entity")
        rows = wide.select(F.lit(2).alias("section"), "o", F.concat_ws("\t", F.lit("PRT"), "chemical_entity", *[short(F.col(f"`{s}`")) for s in samples]).alias("value"))
        lines = lines.union(spark.createDataFrame([(1, 0, header)], lines.schema)).union(rows)
    if runs:
        at = F.element_at(F.create_map(*[x for k, r in enumerate(runs, 1) for x in (F.lit(r), F.lit(k))]), F.col("run_name"))
        ref = F.format_string("ms_run[%d]:index=%d", at, F.col("spectrum_index"))
        row = F.concat_ws("\t", F.lit("PSM"), F.lit("null"), _cell(F.col("ordinal")), _cell(F.col("chemical_entity")), short(F.col("confidence_score")), ref)
        header = "PSH\tsequence\tPSM_ID\taccession\tsearch_engine_score[1]\tspectra_ref"
        lines = lines.union(spark.createDataFrame([(3, 0, header)], lines.schema)).union(identifications.select(F.lit(4), "ordinal", row))
    return lines.select((F.col("section").cast("long") * (1 << 48) + F.col("o")).alias("ordinal"), "value")
