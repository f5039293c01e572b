"""Named queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from omiclake.functions import codecs as C
from omiclake.functions import protection as E
from omiclake.operators import analysis as A
from omiclake.operators import anonymise as N
from omiclake.operators import cohort as Q
from omiclake.operators import filters as P
from omiclake.operators import projections as J
from omiclake.operators import relations as R
from omiclake.plans.views import oracle, table, view
from omiclake.sinks import text_lines as S
from omiclake.sources import text_formats as T
from omiclake.streaming import units as U

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a query under its function's name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (oracle(*views) if views else "") + sql
        return f

    return add


INDEX_QUERY = P.IndexQuery().with_retention_time_range(86400.0, 1728000.0).with_ms_level(2).with_polarity(1).with_precursor_mz_range(310.0, 700.0).with_base_peak_intensity_at_least(20.0)
INDEX_COLUMNS = ["run_name", "spectrum_index", "retention_time", "precursor_mz", "base_peak_intensity"]


@query("SELECT run_name, spectrum_index, retention_time, precursor_mz, base_peak_intensity FROM spectrum_index WHERE retention_time BETWEEN 86400 AND 1728000 AND ms_level = 2 AND polarity = 1 AND precursor_mz BETWEEN 310 AND 700 AND base_peak_intensity >= 20", "spectrum_index")
def index_query(spark, d):
    return INDEX_QUERY.on(view(spark, d, "spectrum_index")).select(*INDEX_COLUMNS)


@query("SELECT spectrum_index FROM spectrum_index WHERE run_name = 'error' AND retention_time BETWEEN 1000 AND 1000000", "spectrum_index")
def rt_range(spark, d):
    return P.IndexQuery().with_retention_time_range(1000.0, 1000000.0).on(view(spark, d, "spectrum_index"), "error").select("spectrum_index")


@query("SELECT run_name, spectrum_index FROM spectrum_index WHERE ms_level = 2", "spectrum_index")
def ms_level(spark, d):
    return P.IndexQuery().with_ms_level(2).on(view(spark, d, "spectrum_index")).select("run_name", "spectrum_index")


@query("SELECT read_index, position FROM reads WHERE chromosome = 'chr2' AND position >= 1000 AND position < 5000", "reads")
def region_half_open(spark, d):
    return view(spark, d, "reads").where(P.in_region("chr2", 1000, 5000)).select("read_index", "position")


@query("SELECT read_index, flags FROM reads WHERE flags & 1040 <> 0", "reads")
def flag_mask(spark, d):
    return view(spark, d, "reads").where(P.has_flag(0x410)).select("read_index", "flags")


@query("SELECT read_index FROM reads WHERE flags & 4 <> 0", "reads")
def unmapped(spark, d):
    return view(spark, d, "reads").where(P.has_flag(P.UNMAPPED)).select("read_index")


@query("SELECT read_index, flags & 4 = 0 AS is_mapped, flags & 1 <> 0 AS is_paired, flags & 16 <> 0 AS is_reverse, flags & 256 <> 0 AS is_secondary, flags & 2048 <> 0 AS is_supplementary FROM reads", "reads")
def read_flags(spark, d):
    return P.with_read_flags(view(spark, d, "reads")).select("read_index", "is_mapped", "is_paired", "is_reverse", "is_secondary", "is_supplementary")


@query("SELECT dataset_id, au_sequence FROM units WHERE dataset_id = 1 AND retention_time >= 5000 AND retention_time <= 2000000 AND ms_level = 2 AND precursor_mz <= 800 AND polarity = 0", "units")
def au_filter(spark, d):
    f = P.UnitFilter.from_json('{"filters": {"dataset_id": 1, "retention_time_min": 5000, "rt_max": 2000000, "ms_level": 2, "precursor_mz_max": 800, "polarity": "positive", "other": 1}}')
    return f.on(view(spark, d, "units")).select("dataset_id", "au_sequence")


@query("SELECT dataset_id, au_sequence, position FROM units WHERE spectrum_class = 5 AND chromosome = 'chr1' AND position BETWEEN 500 AND 8000", "units")
def au_filter_position(spark, d):
    return P.UnitFilter(chromosome="chr1", position_min=500, position_max=8000).on(view(spark, d, "units")).select("dataset_id", "au_sequence", "position")


@query("SELECT dataset_id, au_sequence FROM units WHERE ms_level = 1 ORDER BY dataset_id, au_sequence LIMIT 50", "units")
def max_au_cap(spark, d):
    return P.UnitFilter(ms_level=1, max_au=50).on(view(spark, d, "units")).select("dataset_id", "au_sequence")


@query("SELECT event_id, CASE WHEN t <> 0 OR w <> 0 THEN t - w END AS lower, CASE WHEN t <> 0 OR w <> 0 THEN t + w END AS upper, CASE WHEN t <> 0 OR w <> 0 THEN w + w END AS width FROM (SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 300.0::DOUBLE + user_id ELSE 0.0::DOUBLE END AS t, CASE WHEN event_id % 2 = 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS w FROM events)")
def isolation_window(spark, d):
    odd = F.col("event_id") % 2 == 1
    t, w = F.when(odd, 300.0 + F.col("user_id")).otherwise(0.0), F.when(odd, 0.5).otherwise(0.0)
    x = table(spark, d, "events").select("event_id", P.isolation_window(t, w, w).alias("x"))
    return x.select("event_id", "x.lower", "x.upper", "x.width")


@query("SELECT event_id, len(list_filter(a, lambda x: x = 'MS:' || (user_id % 5))) AS n, list_contains(a, 'MS:1') AS has_it FROM (SELECT event_id, user_id, ['MS:' || (event_id % 5), 'MS:' || (event_id % 3), 'MS:1000'] AS a FROM events)")
def cv_lookup(spark, d):
    e = table(spark, d, "events")
    cv = lambda c: F.struct(F.concat(F.lit("MS:"), c.cast("string")).alias("accession"))
    own = e.withColumn("cv", F.array(cv(F.col("event_id") % 5), cv(F.col("event_id") % 3), cv(F.lit(1000))))
    wanted = F.concat(F.lit("MS:"), (F.col("user_id") % 5).cast("string"))
    return own.select("event_id", F.size(F.filter("cv", lambda p: p["accession"] == wanted)).cast("long").alias("n"), P.has_annotation(F.col("cv"), "MS:1").alias("has_it"))


def cohort_tables(spark, d):
    return {t: view(spark, d, t) for t in ("subjects", "samples", "containers", "phenotypes")}


COHORT = ("subjects", "samples", "containers", "phenotypes")


@query("SELECT subject_id, birth_year FROM subjects WHERE project = 'BUILDING' AND birth_year >= 1950 AND birth_year < 1990", *COHORT)
def cohort_and(spark, d):
    p = Q.subject("project", "eq", "BUILDING") & Q.subject("birth_year", "ge", 1950) & Q.subject("birth_year", "lt", 1990)
    return Q.Cohort(cohort_tables(spark, d), "subjects", p).rows().select("subject_id", "birth_year")


@query("SELECT s.sample_id FROM samples s LEFT JOIN subjects u ON s.subject_id = u.subject_id WHERE (s.tissue = '1-URGENT' OR u.birth_year > 2000) AND NOT (s.mass < 100000)", *COHORT)
def cohort_or_not(spark, d):
    p = (Q.sample("tissue", "eq", "1-URGENT") | Q.subject("birth_year", "gt", 2000)) & ~Q.sample("mass", "lt", 100000.0)
    return Q.Cohort(cohort_tables(spark, d), "samples", p).rows().select("sample_id")


@query("SELECT subject_id FROM subjects WHERE project = 'MACHINERY' AND subject_id IN (SELECT subject_id FROM phenotypes WHERE name = 'R' AND value > 45)", *COHORT)
def cohort_phenotype(spark, d):
    p = Q.subject("project", "eq", "MACHINERY") & Q.phenotype("R", "gt", 45.0)
    return Q.Cohort(cohort_tables(spark, d), "subjects", p).rows().select("subject_id")


@query("SELECT container_id, uri FROM containers WHERE project IN ('NATION_1', 'NATION_2', 'NATION_3') AND uri LIKE '%1%' AND size IS NOT NULL", *COHORT)
def cohort_like_in_exists(spark, d):
    p = Q.container("project", "in", ["NATION_1", "NATION_2", "NATION_3"]) & Q.container("uri", "like", "%1%") & Q.container("size", "exists")
    return Q.Cohort(cohort_tables(spark, d), "containers", p).rows().select("container_id", "uri")


@query("SELECT sample_id, mass FROM samples WHERE tissue = '2-HIGH' AND (mass < 300000 OR (mass = 300000 AND sample_id > 10)) ORDER BY mass DESC, sample_id LIMIT 200", *COHORT)
def cohort_page(spark, d):
    import base64
    import json

    cursor = base64.urlsafe_b64encode(json.dumps([300000.0, 10]).encode()).decode()
    return Q.Cohort(cohort_tables(spark, d), "samples", Q.sample("tissue", "eq", "2-HIGH"), (("mass", True),), 200, cursor).page().select("sample_id", "mass")


@query("SELECT count(*) AS n FROM samples WHERE subject_id IN (SELECT subject_id FROM subjects WHERE birth_year < 1960)", *COHORT)
def cohort_count(spark, d):
    return Q.Cohort(cohort_tables(spark, d), "samples", Q.subject("birth_year", "lt", 1960)).count()


@query("SELECT run_name, spectrum_index, CAST(coalesce(sum(length) OVER (PARTITION BY run_name ORDER BY spectrum_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM spectrum_index", "spectrum_index")
def offsets_from_lengths(spark, d):
    return J.with_offsets(view(spark, d, "spectrum_index")).select("run_name", "spectrum_index", "offset")


def spectra(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.concat(F.lit("run"), (F.col("label") % 3).cast("string")).alias("run_name"), F.col("vec_id").alias("spectrum_index"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("intensity"))


SPECTRA = "WITH spectra AS (SELECT 'run' || CAST(label % 3 AS VARCHAR) AS run_name, vec_id AS spectrum_index, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS intensity FROM embeddings) "


@query(SPECTRA + "SELECT run_name, spectrum_index, coalesce(list_max(intensity), 0.0) AS base_peak FROM spectra")
def base_peak(spark, d):
    return spectra(spark, d).select("run_name", "spectrum_index", J.base_peak(F.col("intensity")).alias("base_peak"))


@query("SELECT dataset_id, au_sequence, CAST(2 AS INTEGER) AS channel_count, CAST(128 AS BIGINT) AS total_elements, octet_length(encode(text)) + octet_length(encode(role)) AS payload_bytes FROM (SELECT conv_id AS dataset_id, turn AS au_sequence, text, role FROM conversations)")
def au_stats(spark, d):
    c = table(spark, d, "conversations")
    channel = lambda x: F.struct(F.lit(64).alias("n_elements"), F.col(x).cast("binary").alias("data"))
    units = c.select(F.col("conv_id").alias("dataset_id"), F.col("turn").alias("au_sequence"), F.lit(0).alias("spectrum_class"), F.array(channel("text"), channel("role")).alias("channels"), F.lit("").alias("chromosome"), F.lit(0).alias("position"), F.lit(0.0).alias("retention_time"))
    return J.unit_stats(units).select("dataset_id", "au_sequence", "channel_count", "total_elements", "payload_bytes")


SPAN = "CASE WHEN regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+') THEN CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) ELSE CAST(0 AS BIGINT) END"


@query(f"SELECT read_index, {SPAN} AS span FROM reads", "reads")
def cigar_span(spark, d):
    return view(spark, d, "reads").select("read_index", J.reference_span(F.col("cigar")).alias("span"))


@query(f", own AS (SELECT *, {SPAN} AS span FROM reads) SELECT DISTINCT read_index FROM own JOIN (SELECT 'chr' || CAST(s_suppkey % 3 + 1 AS VARCHAR) AS c, s_suppkey * 97 % 10000 AS s, s_suppkey * 97 % 10000 + 40 AS e FROM supplier) ON c = chromosome AND position <= e AND position + greatest(span, 1) - 1 >= s", "reads")
def mask_regions_overlap(spark, d):
    s = table(spark, d, "supplier")
    regions = s.select(F.expr("'chr' || CAST(s_suppkey % 3 + 1 AS STRING)").alias("chromosome"), F.expr("s_suppkey * 97 % 10000").alias("start"), F.expr("s_suppkey * 97 % 10000 + 40").alias("end"))
    return N.masked_reads(view(spark, d, "reads"), regions).select("read_index")


@query(f", own AS (SELECT 'run' || CAST(read_index % 2 AS VARCHAR) AS run, read_index // 2 AS ordinal, chromosome, position, {SPAN} AS span, repeat('ACGT', 3) AS sequence FROM reads) SELECT run AS run_name, ordinal AS read_index, CASE WHEN bool_or(s_suppkey IS NOT NULL) THEN repeat('N', 12) ELSE max(sequence) END AS sequence FROM own LEFT JOIN supplier ON 'chr' || CAST(s_suppkey % 3 + 1 AS VARCHAR) = chromosome AND position <= s_suppkey * 97 % 10000 + 40 AND position + greatest(span, 1) - 1 >= s_suppkey * 97 % 10000 GROUP BY 1, 2", "reads")
def mask_regions_of_runs(spark, d):
    s = table(spark, d, "supplier")
    regions = s.select(F.expr("'chr' || CAST(s_suppkey % 3 + 1 AS STRING)").alias("chromosome"), F.expr("s_suppkey * 97 % 10000").alias("start"), F.expr("s_suppkey * 97 % 10000 + 40").alias("end"))
    reads = view(spark, d, "reads").select(F.expr("'run' || CAST(read_index % 2 AS STRING)").alias("run_name"), F.expr("read_index div 2").alias("read_index"), "chromosome", "position", "cigar", F.repeat(F.lit("ACGT"), F.lit(3)).alias("sequence"), F.unhex(F.lit("1E" * 12)).alias("qualities"))
    return N.mask_regions(reads, regions).select("run_name", "read_index", "sequence")


@query("SELECT run_name, read_index, CASE WHEN read_index % 400 < 360 THEN read_index // 400 END AS block FROM reads", "reads")
def block_lookup(spark, d):
    reads = view(spark, d, "reads")
    blocks = reads.select("run_name", F.expr("read_index DIV 400").alias("block")).distinct().select("run_name", "block", (F.col("block") * 400).alias("read_start"), F.lit(360).cast("long").alias("n_reads"))
    return J.block_of(reads, blocks)


@query("SELECT run_name, count(*) AS spectrum_count, count(*) FILTER (ms_level = 1) AS ms1, count(*) FILTER (ms_level = 2) AS ms2 FROM spectrum_index GROUP BY run_name", "spectrum_index")
def manifest_counts(spark, d):
    m = J.manifest(view(spark, d, "spectrum_index"))
    level = lambda k: F.coalesce(F.element_at("ms_level_distribution", F.lit(k)), F.lit(0)).cast("long")
    return m.select("run_name", "spectrum_count", level(1).alias("ms1"), level(2).alias("ms2"))


@query("SELECT run_name, ms_level, count(*) AS n FROM spectrum_index GROUP BY ALL", "spectrum_index")
def ms_level_distribution(spark, d):
    return view(spark, d, "spectrum_index").groupBy("run_name", "ms_level").agg(F.count("*").alias("n"))


IDS = oracle("identifications").replace("WITH ", ", ")


@query(SPECTRA.rstrip() + IDS + "SELECT run_name, spectrum_index FROM spectra s WHERE NOT EXISTS (SELECT 1 FROM identifications i WHERE i.run_name = s.run_name AND i.spectrum_index = s.spectrum_index AND upper(i.chemical_entity) LIKE '%RING%')")
def saav_redact(spark, d):
    ids = view(spark, d, "identifications").withColumn("chemical_entity", F.when(F.upper("chemical_entity").contains("RING"), F.concat(F.lit("variant "), "chemical_entity")).otherwise(F.col("chemical_entity")))
    return N.redact_variants(spectra(spark, d), ids).select("run_name", "spectrum_index")


@query(SPECTRA + "SELECT run_name, spectrum_index, round(list_sum(list_transform(intensity, lambda x: CASE WHEN x < q - 1e-12 THEN 0.0 ELSE x END)), 6) AS kept, len(list_filter(intensity, lambda x: x < q - 1e-12)) AS zeroed FROM (SELECT s.*, (SELECT quantile_cont(x, 0.3) FROM unnest(intensity) AS t(x)) AS q FROM spectra s)")
def quantile_mask(spark, d):
    s = spectra(spark, d).withColumn("masked", A.mask_below_quantile(F.col("intensity"), 0.3))
    total = F.aggregate("masked", F.lit(0.0), lambda a, x: a + x)
    return s.select("run_name", "spectrum_index", F.round(total, 6).alias("kept"), F.size(F.filter("masked", lambda x: x == 0)).cast("long").alias("zeroed"))


@query("SELECT event_id, round_even(value * 10, 0) / 10 AS coarse FROM events")
def coarsen_mz(spark, d):
    return table(spark, d, "events").select("event_id", A.coarsen(F.col("value"), 1).alias("coarse"))


@query(SPECTRA.rstrip() + IDS + "SELECT run_name, spectrum_index, bool_or(p_size < 3) AS masked FROM (SELECT s.run_name, s.spectrum_index, coalesce(m, 99) AS p_size FROM spectra s LEFT JOIN (SELECT i.run_name, i.spectrum_index, m FROM identifications i JOIN (SELECT p_name, min(p_size) AS m FROM part GROUP BY 1) ON chemical_entity = p_name) x ON s.run_name = x.run_name AND s.spectrum_index = x.spectrum_index) GROUP BY ALL")
def rare_mask(spark, d):
    prevalence = table(spark, d, "part").groupBy(F.col("p_name").alias("entity")).agg(F.min("p_size").alias("prevalence"))
    out = N.mask_rare(spectra(spark, d), view(spark, d, "identifications"), prevalence, 3)
    return out.select("run_name", "spectrum_index", (J.base_peak(F.col("intensity")) == 0).alias("masked"))


@query(SPECTRA.rstrip() + IDS + "SELECT i.run_name, i.spectrum_index, i.chemical_entity, round(i.confidence_score, 6) AS confidence FROM identifications i JOIN (SELECT run_name, count(*) AS n FROM spectra GROUP BY 1) k ON i.run_name = k.run_name AND i.spectrum_index < k.n")
def filter_ids(spark, d):
    return N.keep_identifications(view(spark, d, "identifications"), spectra(spark, d)).select("run_name", "spectrum_index", "chemical_entity", F.round("confidence_score", 6).alias("confidence"))


@query("SELECT e.event_id, p.run_name FROM (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events) e JOIN (SELECT event_id AS id, event_type AS run_name FROM events) p ON e.event_id = p.id WHERE k = 42")
def runs_for_sample(spark, d):
    e = table(spark, d, "events")
    runs = e.select(F.col("event_id").alias("run_name"), F.col("event_type").alias("kind"))
    provenance = e.select(F.col("event_id").alias("run_name"), F.array(F.concat(F.lit("sample:"), F.get_json_object("props", "$.k"))).alias("input_refs"))
    return R.runs_for_sample(runs, provenance, "sample:42").select(F.col("run_name").alias("event_id"), F.col("kind").alias("run_name"))


@query("SELECT run_name, min(p) AS source FROM (SELECT c_mktsegment || CAST(c_custkey % 50 AS VARCHAR) AS run_name, 0 AS p FROM customer UNION ALL SELECT 'BUILDING' || CAST(s_suppkey AS VARCHAR), 1 FROM supplier UNION ALL SELECT 'MACHINERY' || CAST(p_partkey AS VARCHAR), 2 FROM part) GROUP BY 1")
def union_runs_first_wins(spark, d):
    a = table(spark, d, "customer").select(F.concat("c_mktsegment", (F.col("c_custkey") % 50).cast("string")).alias("run_name"), F.lit(0).alias("source"))
    b = table(spark, d, "supplier").select(F.concat(F.lit("BUILDING"), F.col("s_suppkey").cast("string")).alias("run_name"), F.lit(1).alias("source"))
    c = table(spark, d, "part").select(F.concat(F.lit("MACHINERY"), F.col("p_partkey").cast("string")).alias("run_name"), F.lit(2).alias("source"))
    return R.all_runs(a, b, c)


@query("SELECT event_id, CASE WHEN e2 IS NULL THEN event_type ELSE e2 END AS entity FROM (SELECT event_id, event_type, 'SME_' || CAST(event_id % 3000 AS VARCHAR) AS ph FROM events) f LEFT JOIN (SELECT 'SME_' || CAST(p_partkey AS VARCHAR) AS id, p_name AS e2 FROM part) p ON f.ph = p.id")
def feature_backfill(spark, d):
    f = table(spark, d, "events").select("event_id", "event_type", F.concat(F.lit("SME_"), (F.col("event_id") % 3000).cast("string")).alias("chemical_entity"))
    e = table(spark, d, "part").select(F.concat(F.lit("SME_"), F.col("p_partkey").cast("string")).alias("sme_id"), F.col("p_name").alias("chemical_entity"), F.lit(1).alias("rank"))
    out = R.backfill(f, e)
    return out.select("event_id", F.when(F.col("chemical_entity").startswith("SME_"), F.col("event_type")).otherwise(F.col("chemical_entity")).alias("entity"))


@query("SELECT p_partkey, coalesce(r_name, 'a' || i) AS sample_ref, v AS abundance FROM (SELECT p_partkey, unnest([1, 2, 9]) AS i, unnest([p_retailprice, CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END, p_retailprice / 2]) AS v FROM part) LEFT JOIN region ON r_regionkey = i WHERE v IS NOT NULL")
def assay_unpivot(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"), (F.col("p_retailprice") / 2).alias("half"))
    labels = table(spark, d, "region").select(F.concat(F.lit("a"), F.col("r_regionkey").cast("string")).alias("assay"), F.col("r_name").alias("sample_ref"))
    return R.unpivoted(p, ["p_partkey"], {"a1": "p_retailprice", "a2": "size", "a9": "half"}, labels)


@query("SELECT chemical_entity, max_by(a, o) FILTER (s = '0') AS s0, max_by(a, o) FILTER (s = '1') AS s1, max_by(a, o) FILTER (s = '2') AS s2 FROM (SELECT p_name AS chemical_entity, CAST(p_partkey % 3 AS VARCHAR) AS s, p_retailprice AS a, p_partkey AS o FROM part) GROUP BY 1")
def mztab_pivot(spark, d):
    q = table(spark, d, "part").select(F.col("p_name").alias("chemical_entity"), (F.col("p_partkey") % 3).cast("string").alias("sample_ref"), F.col("p_retailprice").alias("abundance"), F.col("p_partkey").alias("ordinal"))
    return R.pivoted(q, ["0", "1", "2"]).select("chemical_entity", F.col("0").alias("s0"), F.col("1").alias("s1"), F.col("2").alias("s2"))


@query("SELECT sample_id, subject_id FROM (SELECT sample_id, CASE WHEN subject_id % 10 = 3 THEN -subject_id ELSE subject_id END AS subject_id FROM samples) WHERE subject_id <> 0 AND subject_id NOT IN (SELECT subject_id FROM subjects)", *COHORT)
def soft_fk_orphans(spark, d):
    own = F.col("subject_id")
    samples = view(spark, d, "samples").withColumn("subject_id", F.when(own % 10 == 3, -own).otherwise(own))
    return R.orphan_samples(samples, view(spark, d, "subjects")).select("sample_id", "subject_id")


@query("SELECT name, CAST(row_number() OVER (ORDER BY f, name) - 1 AS INTEGER) AS id FROM (SELECT p_name AS name, min(p_partkey) AS f FROM part GROUP BY 1)")
def chrom_intern(spark, d):
    return R.interned(table(spark, d, "part").select(F.col("p_name").alias("name"), "p_partkey"), "name", "p_partkey")


COS = """WITH s AS (SELECT CAST(label AS INTEGER) AS label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
 w AS (SELECT label, vec_id, unnest(range(len(a))) AS i, a FROM s),
 r AS (SELECT label, vec_id, i, a[i + 1] AS x FROM w),
 c AS (SELECT label, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS k, i, x - avg(x) OVER (PARTITION BY label, i) AS d, count(*) OVER (PARTITION BY label, i) AS m FROM r) """


@query(COS + "SELECT p.label, CAST(p.i AS INTEGER) AS i, CAST(q.i AS INTEGER) AS j, round(sum(p.d * q.d) / (min(p.m) - 1), 6) + 0.0 AS value FROM c p JOIN c q ON p.label = q.label AND p.k = q.k GROUP BY ALL")
def two_d_cos_sync(spark, d):
    return cos(spark, d).select("label", "i", "j", (F.round("synchronous", 6) + 0.0).alias("value"))


@query(COS + ", n AS (SELECT p.label, p.k, q.i, sum(q.d / (pi() * (q.k - p.k))) AS d FROM (SELECT DISTINCT label, k FROM c) p JOIN c q ON p.label = q.label AND p.k <> q.k GROUP BY ALL) SELECT p.label, CAST(p.i AS INTEGER) AS i, CAST(q.i AS INTEGER) AS j, round(sum(p.d * q.d) / (min(p.m) - 1), 6) + 0.0 AS value FROM c p JOIN n q ON p.label = q.label AND p.k = q.k GROUP BY ALL")
def two_d_cos_async(spark, d):
    return cos(spark, d).select("label", "i", "j", (F.round("asynchronous", 6) + 0.0).alias("value"))


def cos(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("int").alias("label"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("intensity"))
    return A.correlation_2d(e, "label", "vec_id")


#: Code points of a document's whole text, for DuckDB and for Spark; none of a null text.
CODES = "list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: unicode(c))"


def codes():
    return C.code_points(F.coalesce("text", F.lit("")))


@query("SELECT event_id, CASE WHEN value + user_id > 0 THEN round(value / (value + user_id), 9) END AS ratio FROM events")
def disrelation(spark, d):
    r = A.disrelation(F.col("value"), F.col("user_id").cast("double"))
    return table(spark, d, "events").select("event_id", F.when(~F.isnan(r), F.round(r, 9)).alias("ratio"))


@query("SELECT CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, CASE WHEN j = k THEN 0.0 ELSE round(1 / (pi() * (k - j)), 12) END AS value FROM range(40) a(j), range(40) b(k)")
def hilbert_noda(spark, d):
    return A.hilbert_noda(spark, 40).withColumn("value", F.round("value", 12))


@query("SELECT doc_id, CAST(coalesce(list_sum(list_transform(q, lambda x: CASE WHEN x < 2 THEN 0 WHEN x < 10 THEN 5 WHEN x < 20 THEN 15 WHEN x < 25 THEN 22 WHEN x < 30 THEN 27 WHEN x < 35 THEN 32 WHEN x < 40 THEN 37 ELSE 40 END)), 0) AS BIGINT) AS total FROM (SELECT doc_id, list_transform(" + CODES + ", lambda x: x % 94) AS q FROM documents)")
def quality_binned(spark, d):
    q = F.transform(codes(), lambda x: x % 94)
    return table(spark, d, "documents").select("doc_id", F.aggregate(F.transform(q, C.binned_quality), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT doc_id, NOT regexp_matches(lower(p), 'hifi|pacbio|nanopore|(^|[^a-z0-9])ont([^a-z0-9]|$)') AS allowed FROM (SELECT doc_id, ['ILLUMINA', 'PacBio HiFi', 'ONT', 'front', 'x-ont 2'][doc_id % 5 + 1] AS p FROM documents)")
def quality_platform_gate(spark, d):
    p = F.element_at(F.array(*map(F.lit, ["ILLUMINA", "PacBio HiFi", "ONT", "front", "x-ont 2"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", C.binning_allowed(p).alias("allowed"))


@query(SPECTRA + "SELECT spectrum_index, CAST(list_sum(list_transform(range(2, len(x) + 1), lambda i: abs(x[i] - x[i - 1]))) AS BIGINT) AS moved, true AS same FROM (SELECT spectrum_index, list_transform(intensity, lambda v: CAST(round_even(v * 1000, 0) AS BIGINT)) AS x FROM spectra)")
def numpress_roundtrip(spark, d):
    s = spectra(spark, d).withColumn("deltas", C.numpress_deltas(F.col("intensity"), 1000.0)).withColumn("back", C.numpress_values(F.col("deltas"), 1000.0))
    near = F.forall(F.zip_with("intensity", "back", lambda a, b: F.abs(a - b) <= 0.000501), lambda x: x)
    moved = F.aggregate(F.slice("deltas", F.lit(2), F.size("deltas")), F.lit(0).cast("long"), lambda a, x: a + F.abs(x))
    return s.select("spectrum_index", moved.alias("moved"), near.alias("same"))


@query("SELECT event_id, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS code, v AS back FROM (SELECT event_id, user_id - event_id AS v FROM events)")
def delta_zigzag(spark, d):
    z = C.zigzag(F.col("user_id") - F.col("event_id"))
    return table(spark, d, "events").select("event_id", z.alias("code")).select("event_id", "code", C.unzigzag(F.col("code")).alias("back"))


@query("SELECT doc_id, CASE WHEN list_min(q) < 59 THEN 33 WHEN list_min(q) >= 64 AND list_max(q) <= 104 THEN 64 ELSE 33 END AS o FROM (SELECT doc_id, list_transform(" + CODES + ", lambda x: 58 + doc_id % 9 + x % 40) AS q FROM documents)")
def phred_detect(spark, d):
    q = F.transform(codes(), lambda x: 58 + F.col("doc_id") % 9 + x % 40)
    return table(spark, d, "documents").select("doc_id", C.phred_offset(q).alias("o"))


@query("SELECT read_index, CASE WHEN row_number() OVER (PARTITION BY read_name ORDER BY read_index) > 1 THEN read_name || '#' || CAST(read_index AS VARCHAR) ELSE read_name END AS read_name FROM reads", "reads")
def fastq_dedup_names(spark, d):
    return R.deduplicated_names(view(spark, d, "reads")).select("read_index", "read_name")


@query("SELECT event_id, CAST(CASE s WHEN 1 THEN 0 WHEN -1 THEN 1 ELSE 2 END AS INTEGER) AS wire, CAST(s AS INTEGER) AS stored FROM (SELECT event_id, event_id % 3 - 1 AS s FROM events)")
def polarity_wire(spark, d):
    w = J.wire_polarity(F.col("polarity"))
    return view(spark, d, "spectrum_index").select(F.col("spectrum_index").alias("event_id"), w.alias("wire"), J.stored_polarity(w).alias("stored"))


@query("SELECT event_id, round(1.0 / CASE WHEN r = 0 THEN 1 ELSE r END, 9) AS confidence FROM (SELECT event_id, event_id % 7 AS r FROM events)")
def sme_confidence(spark, d):
    return table(spark, d, "events").select("event_id", F.round(R.rank_confidence(F.col("event_id") % 7), 9).alias("confidence"))


@query("SELECT c_custkey, '{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}' AS attributes FROM customer")
def json_attributes(spark, d):
    return table(spark, d, "customer").select("c_custkey", J.sorted_json(F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name")).alias("attributes"))


@query("SELECT dataset_id, arrival, au_sequence FROM (SELECT *, lag(au_sequence) OVER (PARTITION BY dataset_id ORDER BY arrival) AS b FROM (SELECT user_id AS dataset_id, event_id AS arrival, event_id * 7 % 101 AS au_sequence FROM events)) WHERE au_sequence <= b")
def au_sequence_monotonic(spark, d):
    u = table(spark, d, "events").select(F.col("user_id").alias("dataset_id"), F.col("event_id").alias("arrival"), (F.col("event_id") * 7 % 101).alias("au_sequence"))
    return R.sequence_errors(u).select("dataset_id", "arrival", "au_sequence")


@query("SELECT run_name, spectrum_index, CASE WHEN ms_level = 2 THEN coalesce(last_value(CASE WHEN ms_level = 1 THEN base_peak_intensity END IGNORE NULLS) OVER (PARTITION BY run_name ORDER BY spectrum_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) ELSE 0.0 END AS precursor_mz FROM spectrum_index", "spectrum_index")
def ms1_carry_forward(spark, d):
    return R.carried_precursor(view(spark, d, "spectrum_index").withColumn("base_peak_mz", F.col("base_peak_intensity"))).select("run_name", "spectrum_index", "precursor_mz")


@query("SELECT n_regionkey AS uri, md5(string_agg(repeat('ACGT', n_nationkey + 1), '' ORDER BY n_name)) AS md5, CAST(sum(4 * (n_nationkey + 1)) AS BIGINT) AS total_bases FROM nation GROUP BY 1")
def reference_md5(spark, d):
    c = table(spark, d, "nation").select(F.col("n_regionkey").alias("uri"), F.col("n_name").alias("name"), F.expr("repeat('ACGT', n_nationkey + 1)").alias("sequence"))
    return J.reference_md5(c)


@query("SELECT coalesce(i.chemical_entity, q.p_name) AS chemical_entity, round(greatest(coalesce(b, 0), 0), 6) AS confidence, q.p_name IS NOT NULL AS quantified FROM (SELECT chemical_entity, max(confidence_score) AS b FROM identifications GROUP BY 1) i FULL JOIN (SELECT DISTINCT CASE WHEN p_size > 40 THEN p_name ELSE p_brand END AS p_name FROM part) q ON i.chemical_entity = q.p_name", "identifications")
def sml_best_confidence(spark, d):
    q = table(spark, d, "part").select(F.when(F.col("p_size") > 40, F.col("p_name")).otherwise(F.col("p_brand")).alias("chemical_entity")).distinct()
    return R.best_confidence(view(spark, d, "identifications"), q).withColumn("confidence", F.round("confidence", 6))


@query(""", x AS (SELECT run_name, read_index, sum(CASE WHEN chromosome <> p THEN 1 ELSE 0 END) OVER (PARTITION BY run_name ORDER BY read_index) AS island FROM (SELECT *, lag(chromosome) OVER (PARTITION BY run_name ORDER BY read_index) AS p FROM reads)),
 y AS (SELECT *, (row_number() OVER (PARTITION BY run_name, island ORDER BY read_index) - 1) // 2 AS part FROM x)
 SELECT run_name, read_index, CAST(dense_rank() OVER (PARTITION BY run_name ORDER BY island, part) - 1 AS BIGINT) AS block FROM y""", "reads")
def block_islands(spark, d):
    return J.block_islands(view(spark, d, "reads"), 2).select("run_name", "read_index", "block")


@query("SELECT doc_id, CASE WHEN len(t) = 0 THEN 1.0 ELSE round(len(regexp_replace(t, '[^ACGT]', '', 'g')) / len(t), 9) END AS fraction FROM (SELECT doc_id, coalesce(array_to_string(list_transform(" + CODES + ", lambda x: 'ACGTN'[x % 5 + 1]), ''), '') AS t FROM documents)")
def packable_fraction(spark, d):
    t = C.letters(F.coalesce("text", F.lit("")), "ACGTN")
    return table(spark, d, "documents").select("doc_id", F.round(J.packable_fraction(t), 9).alias("fraction"))


@query("SELECT n_regionkey AS uri, CAST(sum(len(n_name)) AS BIGINT) AS total_bases FROM nation GROUP BY 1")
def reference_total_bases(spark, d):
    c = table(spark, d, "nation").select(F.col("n_regionkey").alias("uri"), F.col("n_name").alias("name"), F.col("n_name").alias("sequence"))
    return J.reference_md5(c).select("uri", "total_bases")


@query("SELECT count(*) AS frame_count, count(*) FILTER (event_id % 4 = 0) AS ms1_count, count(*) FILTER (event_id % 4 <> 0) AS ms2_count, coalesce(min(value), 0.0) AS time_min, coalesce(max(value), 0.0) AS time_max FROM events")
def bruker_style_metadata(spark, d):
    return A.frames_summary(table(spark, d, "events").select((F.col("event_id") % 4).alias("msms_type"), F.col("value").alias("time")))


@query("SELECT n_name AS name, length, CAST(coalesce(sum(len(n_name) + 2 + length + ceil(length / 60.0)) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len(n_name) + 2 AS BIGINT) AS \"offset\" FROM (SELECT *, CAST(4 * (n_nationkey * 7 + 1) AS BIGINT) AS length FROM nation)")
def fasta_fai(spark, d):
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"), F.expr("repeat('ACGT', n_nationkey * 7 + 1)").alias("sequence"))
    return S.fasta_index(c).select("name", "length", "offset")


SAM = """SELECT read_index, read_name || chr(9) || flags || chr(9) || chromosome || chr(9) || position || chr(9) || mapping_quality || chr(9) || cigar || chr(9) ||
 CASE WHEN mate_chromosome = '*' THEN '*' WHEN mate_chromosome = chromosome THEN '=' ELSE mate_chromosome END || chr(9) || greatest(mate_position, 0) || chr(9) || template_length || chr(9) || 'ACGT' || chr(9) || '!!!!' AS value FROM reads"""


def sam_reads(spark, d):
    return view(spark, d, "reads").withColumns({"sequence": F.lit("ACGT"), "qualities": F.lit(b"!!!!"), "tags": F.lit("")})


@query(SAM, "reads")
def sam_line_projection(spark, d):
    return S.sam_lines(sam_reads(spark, d)).select("read_index", "value")


@query("SELECT read_index, row_number() OVER (ORDER BY chromosome, position, read_index) AS place FROM reads", "reads")
def sam_sort(spark, d):
    return S.coordinate_places(view(spark, d, "reads"))


@query("SELECT r_name AS run_name, coalesce(string_agg(n_name, ';' ORDER BY n_nationkey), '') AS derived_files FROM region LEFT JOIN nation ON n_regionkey % 4 = r_regionkey GROUP BY 1")
def isa_derived_list(spark, d):
    runs = table(spark, d, "region").select(F.col("r_name").alias("run_name"), "r_regionkey")
    c = table(spark, d, "nation").join(F.broadcast(runs), F.col("n_regionkey") % 4 == F.col("r_regionkey")).select("run_name", F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"))
    return S.isa_assays(runs, c)


@query("SELECT 'f' AS path, CAST(n_nationkey AS INTEGER) AS line_no, CASE n_nationkey % 4 WHEN 0 THEN 'S' || chr(9) || n_name || chr(9) || 'ACGT' WHEN 1 THEN 'L' || chr(9) || n_name || chr(9) || '+' || chr(9) || 'x' || chr(9) || '-' || chr(9) || '4M' WHEN 2 THEN 'P' || chr(9) || n_name || chr(9) || 'a+,b-' || chr(9) || '*' ELSE 'S' || chr(9) || n_name END AS value FROM nation")
def gfa_line_order(spark, d):
    n, t = table(spark, d, "nation"), "\t"
    k, name = F.col("n_nationkey") % 4, F.col("n_name")
    line = F.when(k == 0, F.concat(F.lit("S\t"), name, F.lit(t + "ACGT"))).when(k == 1, F.concat(F.lit("L\t"), name, F.lit("\t+\tx\t-\t4M"))).when(k == 2, F.concat(F.lit("P\t"), name, F.lit("\ta+,b-\t*"))).otherwise(F.concat(F.lit("S\t"), name))
    lines = n.select(F.lit("f").alias("path"), F.col("n_nationkey").alias("line_no"), line.alias("value"))
    return S.gfa_lines(T.gfa(lines))


@query("SELECT conv_id, turn, CAST(strlen(text) AS INTEGER) AS n_ciphertext, CAST(16 AS INTEGER) AS n_tag, text FROM conversations")
def aes_au_roundtrip(spark, d):
    key = F.lit(bytes(range(32)))
    c = table(spark, d, "conversations").withColumn("aad", E.channel_aad(F.col("conv_id"), F.col("turn"), F.lit("text")))
    iv = F.substring(F.unhex(F.sha2(F.concat_ws(":", "conv_id", "turn"), 256)), F.lit(1), F.lit(12))
    box = c.withColumn("box", E.sealed(F.col("text").cast("binary"), key, iv, F.col("aad")))
    plain = E.opened(F.col("box"), key, F.col("aad")).cast("string").alias("text")
    return box.select("conv_id", "turn", F.octet_length("box.ciphertext").alias("n_ciphertext"), F.octet_length("box.tag").alias("n_tag"), plain)


@query("SELECT doc_id, strlen(t) AS n_bases, strlen(regexp_replace(t, '[ACGT]', '', 'g')) AS n_exceptions, t AS unpacked FROM (SELECT doc_id, translate(text, 'acgteiou', 'ACGTACGT') AS t FROM documents)")
def base_pack_roundtrip(spark, d):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            packed = [C.pack_bases(x or b"") for x in b.column(1).to_pylist()]
            heads = [C.read_varint(p) for p in packed]
            n, m = [h[0] for h in heads], [C.read_varint(p, h[1])[0] for p, h in zip(packed, heads, strict=True)]
            back = pa.array([C.unpack_bases(p) for p in packed], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), back], ["doc_id", "n_bases", "n_exceptions", "unpacked"])

    acgt = F.translate("text", "acgteiou", "ACGTACGT").cast("binary")
    return table(spark, d, "documents").select("doc_id", acgt.alias("x")).mapInArrow(run, "doc_id bigint, n_bases bigint, n_exceptions bigint, unpacked string")


@query("SELECT event_id, list_sum([event_id % 50, event_id % 50 + 3, event_id % 50 + 3, event_id % 50 + 1])::DOUBLE / 2 AS total FROM events")
def jcamp_decode(spark, d):
    v = (F.col("event_id") % 50 + 1000).cast("string")
    body = F.concat(F.lit("##TITLE=t\n##DATA TYPE=INFRARED SPECTRUM\n##FIRSTX=0\n##DELTAX=1\n##YFACTOR=0.5\n##XYDATA=(X++(Y..Y))\n0 "), F.lit("A"), F.substring(v, 2, 3), F.lit("L%k\n##END="))
    files = table(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), body.alias("value"))
    total = F.aggregate("y", F.lit(0.0), lambda a, x: a + x) - 2000.0
    return T.jcamp(files).select(F.col("path").cast("long").alias("event_id"), total.alias("total"))


@query("SELECT read_index, true AS in_range, CAST(8 AS BIGINT) AS n FROM reads", "reads")
def seeded_qualities(spark, d):
    reads = view(spark, d, "reads").withColumn("qualities", F.unhex(F.lit("00" * 8)))
    out = N.seeded_qualities(reads.select("run_name", "read_index", "qualities"), 7)
    return out.select("read_index", (~F.hex("qualities").rlike("^(..)*([6-9A-F][0-9A-F]|5[EF])")).alias("in_range"), F.octet_length("qualities").cast("long").alias("n"))


@query("SELECT value AS au_sequence, CAST(CASE WHEN value % 5 = 0 THEN 1 ELSE 2 END AS INTEGER) AS ms_level, true AS ok FROM (SELECT event_id AS value FROM events)")
def acquisition_simulator(spark, d):
    s = U.simulated(table(spark, d, "events").select(F.col("event_id").alias("value")), peaks=20)
    n = F.size("mz")
    return s.select("au_sequence", "ms_level", ((n >= 15) & (n <= 25) & (F.array_sort("mz") == F.col("mz")) & (F.array_max("intensity") == F.col("base_peak_intensity"))).alias("ok"))


from omiclake.plans import catalog_more  # noqa: E402, F401  registers its queries
