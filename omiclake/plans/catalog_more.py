"""More named queries: blocks, stores, codecs, stream units, sealed rows and documents, with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from omiclake.functions import canonical as K
from omiclake.functions import codecs as C
from omiclake.functions import entropy as Z
from omiclake.operators import access as A
from omiclake.operators import anonymise as N
from omiclake.operators import blocks as B
from omiclake.operators import filters as P
from omiclake.operators import projections as J
from omiclake.operators import relations as R
from omiclake.plans.catalog import query
from omiclake.plans.views import table, view
from omiclake.session import scratch
from omiclake.sources import mztab as M
from omiclake.sources import text_formats as T
from omiclake.sources import units_codec as U
from omiclake.store import container as S


@query("SELECT read_index, CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIS=X]', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS n FROM reads", "reads")
def read_lengths(spark, d):
    return view(spark, d, "reads").select("read_index", B.read_length(F.lit(""), F.col("cigar")).alias("n"))


@query("SELECT event_id // 1000 AS block, count(*) AS n, min(event_id) AS first, max(value) AS most FROM events GROUP BY 1")
def blocks_by_function(spark, d):
    run = table(spark, d, "events").select("event_id", "value")
    one = lambda block, t: pa.table({"block": pa.array([block], pa.int64()), "n": pa.array([t.num_rows], pa.int64()), "first": t["event_id"].slice(0, 1), "most": pa.array([max(t["value"].to_pylist())], pa.float64())})
    return B.for_each_block(run, one, "block bigint, n bigint, first bigint, most double", order="event_id", size=1000)


@query(", placed AS (SELECT read_index, read_index % 97 + 1 AS bytes, sum(read_index % 97 + 1) OVER (ORDER BY read_index) - (read_index % 97 + 1) AS place FROM reads) SELECT min(read_index) AS first, count(*) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes FROM placed GROUP BY place // 5000", "reads")
def block_budgets(spark, d):
    return B.block_budget(view(spark, d, "reads").select("read_index", (F.col("read_index") % 97 + 1).alias("bytes")), 5000)


def generated(spark, d):
    """Spectra of 0 to 16 values, made from an event's number."""
    n = (F.col("event_id") % 17).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return table(spark, d, "events").select(F.col("event_id").alias("spectrum_index"), F.transform(at, lambda i: (F.col("event_id") * 20 + i).cast("double")).alias("mz"), F.transform(at, lambda i: (F.col("event_id") % 7 + i).cast("double")).alias("intensity"))


@query("SELECT event_id AS spectrum_index, CAST(event_id % 17 AS INTEGER) AS n, CASE WHEN event_id % 17 > 0 THEN CAST(event_id * 20 + 1 AS DOUBLE) END AS first_mz, CASE WHEN event_id % 17 > 0 THEN CAST(event_id * 20 + event_id % 17 AS DOUBLE) END AS last_mz, CASE WHEN event_id % 17 > 0 THEN CAST(event_id % 7 + event_id % 17 AS DOUBLE) END AS most FROM events")
def spectra_assembled(spark, d):
    index, chunks = S.signal_chunks(generated(spark, d), ["mz", "intensity"], size=256)
    out = S.assembled(index, chunks, ["mz", "intensity"], size=256)
    return out.select("spectrum_index", F.size("mz").alias("n"), F.get("mz", F.lit(0)).alias("first_mz"), F.array_max("mz").alias("last_mz"), F.array_max("intensity").alias("most"))


@query("SELECT spectrum_index, value FROM (SELECT spectrum_index, value, row_number() OVER (ORDER BY value) - 1 AS place FROM (SELECT event_id AS spectrum_index, CAST(unnest(range(event_id * 20 + 1, event_id * 20 + event_id % 17 + 1)) AS DOUBLE) AS value FROM events)) WHERE place >= 100 AND place < 400")
def channel_values(spark, d):
    return A.channel_range(generated(spark, d), "mz", 100, 300)


@query("SELECT event_id AS spectrum_index, value FROM events WHERE event_id >= 100 AND event_id < 350 UNION ALL SELECT event_id, value FROM events WHERE event_id = (SELECT max(event_id) FROM events) - 1")
def slice_and_point(spark, d):
    run = table(spark, d, "events").select(F.col("event_id").alias("spectrum_index"), "value")
    return A.in_range(run, 100, 350, "spectrum_index").union(A.at_index(run, -2, "spectrum_index"))


@query("SELECT event_id AS idx, CASE WHEN event_id BETWEEN 10 AND 19 THEN -value ELSE value END AS value FROM events UNION ALL SELECT event_id + (SELECT count(*) FROM events), value FROM events WHERE event_id < 5")
def container_dataset(spark, d):
    c, rows = S.Container(spark, scratch(spark, "container")), table(spark, d, "events").select(F.col("event_id").alias("idx"), "value")
    c.create_dataset("/runs/a/signal", rows)
    c.append("/runs/a/signal", rows.where("idx < 5"))
    c.write_slice("/runs/a/signal", 10, rows.where("idx BETWEEN 10 AND 19").select((F.col("idx") - 10).alias("idx"), (-F.col("value")).alias("value")))
    return c.read("/runs/a/signal")


@query("SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(i AS BIGINT) AS i1, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(3, 7) t(i) WHERE vec_id >= 5 AND vec_id < 40")
def container_box(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    shape = (table(spark, d, "embeddings").count(), 64)
    c = S.Container(spark, scratch(spark, "container"))
    c.create_dataset("/cube", e.select((F.col("vec_id") * 64 + F.col("k")).alias("idx"), F.col("x").cast("double").alias("value")), shape)
    return c.read_box("/cube", (5, 3), (40, 7)).select(F.col("i0").cast("long").alias("vec_id"), F.col("i1").cast("long").alias("i1"), "value")


@query("SELECT dataset_id, au_sequence, spectrum_class, retention_time, ms_level, polarity, precursor_mz, precursor_charge, CASE WHEN spectrum_class = 5 THEN chromosome END AS chromosome, CASE WHEN spectrum_class = 5 THEN position END AS position FROM units", "units")
def unit_bytes(spark, d):
    back = U.unpacked_units(U.packed_units(view(spark, d, "units")))
    return back.select("dataset_id", "au_sequence", "spectrum_class", "retention_time", "ms_level", "polarity", "precursor_mz", "precursor_charge", "chromosome", "position")


@query("SELECT dataset_id, au_sequence FROM units WHERE (retention_time >= 86400 OR isnan(retention_time)) AND ms_level = 2 AND precursor_charge = 3", "units")
def client_filter(spark, d):
    message = P.UnitFilter(rt_min=86400.0, ms_level=2, precursor_charge=3).to_json()
    return P.UnitFilter.from_json(message).on(view(spark, d, "units")).select("dataset_id", "au_sequence")


@query("SELECT dataset_id, au_sequence FROM units WHERE spectrum_class = 5 AND chromosome = 'chr1' AND position <= 5000", "units")
def pair_filter(spark, d):
    return P.UnitFilter.from_dict(P.parse_pairs(["chromosome=chr1", "position_max=5000"])).on(view(spark, d, "units")).select("dataset_id", "au_sequence")


@query("SELECT item_id, strlen(text) AS n, text AS order_0, text AS order_1 FROM benchmark")
def entropy_coded(spark, d):
    df = table(spark, d, "benchmark").select("item_id", F.octet_length("text").cast("long").alias("n"), F.col("text").cast("binary").alias("order_0"), F.col("text").cast("binary").alias("order_1"))
    for column, number in (("order_0", 4), ("order_1", 5)):
        df = Z.coded(Z.coded(df, column, number), column, number, decode=True)
    return df.select("item_id", "n", F.col("order_0").cast("string").alias("order_0"), F.col("order_1").cast("string").alias("order_1"))


def _through(df, encode, decode, kind):
    """vec_id, i and x of arrays that went through a codec of arrays."""

    def run(batches):
        for b in batches:
            out = [decode(encode(np.asarray(x))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o.tolist() for o in out], pa.list_(kind))], ["vec_id", "x"])

    name = "double" if pa.types.is_floating(kind) else "bigint"
    return df.mapInArrow(run, f"vec_id bigint, x array<{name}>").select("vec_id", F.posexplode("x").alias("i", "x"))


@query("SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(0, 64) t(i)")
def floats_coded(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return _through(rows, Z.floats_encode, Z.floats_decode, pa.float64())


@query("SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(round_even(CAST(embedding[i + 1] AS DOUBLE) * 1000, 0) AS BIGINT) AS x FROM embeddings, range(0, 64) t(i)")
def deltas_coded(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.rint(v.cast("double") * 1000).cast("long")).alias("x"))
    return _through(rows, Z.delta_encode, Z.delta_decode, pa.int64())


@query("SELECT doc_id, t AS bases FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS t FROM documents)")
def packed_references(spark, d):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([Z.unpacked_reference(Z.packed_reference(x or "")) for x in b.column(1).to_pylist()])], ["doc_id", "bases"])

    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("t")).mapInArrow(run, "doc_id bigint, bases string")


@query("SELECT CAST(i AS BIGINT) AS i, substr(string_agg(p_name, '' ORDER BY p_partkey), CAST(i * 50 + 1 AS BIGINT), 120) AS bases FROM part, range(0, 20) t(i) GROUP BY i")
def reference_lookups(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("sequence"))
    parts = B.joined_parts(names, "ref", "chr1", "p_partkey", 64)
    ranges = spark.range(20).select(F.col("id").alias("i"), (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 120).alias("stop"))
    return B.reference_slices(parts, "ref", "chr1", ranges, 64).select("i", "bases")


@query("SELECT conv_id, turn, 8 + 8 + 4 + strlen(text) AS n, CAST(strlen(text) AS BIGINT) AS told FROM conversations")
def canonical_rows(spark, d):
    rows = K.canonical_bytes(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn", "text"])
    byte = lambda k: F.conv(F.hex(F.substring("canonical", 17 + k, 1)), 16, 10).cast("long")
    return rows.select("conv_id", "turn", F.octet_length("canonical").cast("long").alias("n"), (byte(0) + byte(1) * 256 + byte(2) * 65536).alias("told"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def table_sealed(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return K.opened_table(K.sealed_table(rows, bytes(range(32)), "conversations"), bytes(range(32)), "conversations", rows.schema)


@query("SELECT dataset_id, au_sequence, retention_time, ms_level, polarity, precursor_mz, precursor_charge, CAST(36 AS INTEGER) AS n FROM units", "units")
def headers_sealed(spark, d):
    key, aad = F.lit(bytes(range(32))), F.concat_ws(":", "dataset_id", "au_sequence").cast("binary")
    iv = F.substring(F.unhex(F.sha2(F.concat_ws(":", "dataset_id", "au_sequence"), 256)), F.lit(1), F.lit(12))
    hidden = K.sealed_headers(view(spark, d, "units").drop("spectrum_class", "chromosome", "position"), key, iv, aad)
    hidden = hidden.withColumn("n", F.octet_length("header.ciphertext"))
    return K.opened_headers(hidden, key, aad).select("dataset_id", "au_sequence", "retention_time", "ms_level", "polarity", "precursor_mz", "precursor_charge", "n")


def _document(spark, d, head, row):
    rows = table(spark, d, "part").select((F.col("p_partkey") + 100).alias("line_no"), row.alias("value"))
    return spark.createDataFrame([(k, v) for k, v in enumerate(head)], "line_no bigint, value string").union(rows).select(F.lit("f").alias("path"), "line_no", "value")


@query("SELECT 'P' || p_partkey AS chemical_entity, s AS sample_ref, CASE s WHEN 's1' THEN CAST(p_size AS DOUBLE) ELSE p_size * 2.0 END AS abundance FROM part, (VALUES ('s1'), ('assay_2')) t(s) WHERE s = 's1' OR p_partkey % 3 <> 0")
def protein_quantities(spark, d):
    second = F.when(F.col("p_partkey") % 3 == 0, "null").otherwise((F.col("p_size") * 2).cast("string"))
    row = F.concat_ws("\t", F.lit("PRT"), F.concat(F.lit("P"), "p_partkey"), F.col("p_size").cast("string"), second)
    lines = _document(spark, d, ["MTD\tassay[1]-sample_ref\ts1", "PRH\taccession\tprotein_abundance_assay[1]\tprotein_abundance_assay[2]"], row)
    return M.protein_quantities(lines).select("chemical_entity", "sample_ref", "abundance")


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'CHEBI:' || p_partkey ELSE p_name END AS chemical_entity, CAST(p_size AS DOUBLE) / 100 AS confidence_score, CASE WHEN p_partkey % 2 = 0 THEN 'name=' || p_name ELSE '' END AS evidence FROM part")
def small_molecules(spark, d):
    ident = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("CHEBI:"), "p_partkey")).otherwise("null")
    row = F.concat_ws("\t", F.lit("SML"), ident, "p_name", (F.col("p_size").cast("double") / 100).cast("string"))
    lines = _document(spark, d, ["SMH\tdatabase_identifier\tchemical_name\tbest_id_confidence_value"], row)
    return M.small_molecules(lines).select("chemical_entity", "confidence_score", F.array_join("evidence_chain", ";").alias("evidence"))


@query("SELECT 'F' || p_partkey AS feature_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'E' || p_partkey END AS chemical_entity, CAST(p_size AS DOUBLE) AS exp_mz, CAST(p_size * 3 AS DOUBLE) AS abundance FROM part")
def features_of_evidence(spark, d):
    feature = F.concat_ws("\t", F.lit("SMF"), F.concat(F.lit("F"), "p_partkey"), F.concat(F.lit("E"), "p_partkey", F.lit("|E0")), F.col("p_size").cast("string"), (F.col("p_size") * 3).cast("string"))
    proof = F.concat_ws("\t", F.lit("SME"), F.concat(F.lit("E"), "p_partkey"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("null"), F.lit("1"))
    features = M.features(_document(spark, d, ["SFH\tSMF_ID\tSME_ID_REFS\texp_mass_to_charge\tabundance_assay[1]"], feature), "SMF").drop("path", "line_no")
    evidence = M.evidence(_document(spark, d, ["SEH\tSME_ID\tchemical_name\trank"], proof)).select("sme_id", "chemical_entity", "rank")
    return R.backfill(features, evidence).select("feature_id", "chemical_entity", "exp_mz", F.element_at("abundances", F.lit("assay_1")).alias("abundance"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, 'r' || o_orderkey AS name, repeat('ACGT', CAST(o_orderkey % 5 AS INTEGER)) AS sequence FROM orders")
def fastq_read(spark, d):
    n = (F.col("o_orderkey") % 5).cast("int")
    rows = table(spark, d, "orders").orderBy("o_orderkey").coalesce(1)
    path = scratch(spark, "fastq")
    rows.select(F.concat(F.lit("@r"), "o_orderkey", F.lit(" x\n"), F.repeat(F.lit("ACGT"), n), F.lit("\n+\n"), F.repeat(F.lit("@+I#"), n)).alias("value")).write.text(path)
    return T.fastq_lines(spark, path).select("ordinal", "name", "sequence")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS read_index, 'p' || p_partkey AS read_name, regexp_replace(p_name, '\\s', '', 'g') AS sequence FROM part")
def fasta_read(spark, d):
    path = scratch(spark, "fasta")
    rows = table(spark, d, "part").orderBy("p_partkey").coalesce(1)
    rows.select(F.concat(F.lit(">p"), "p_partkey", F.lit(" y\n"), F.regexp_replace("p_name", "(.{3})(?=.)", "$1\n")).alias("value")).write.text(path)
    return T.fasta_reads(spark, path).select("read_index", "read_name", "sequence")


@query("SELECT event_id, CAST(2 AS INTEGER) AS n, 'i' || event_id AS nm FROM events")
def tags_split(spark, d):
    tags = F.concat(F.lit("NM:Z:i"), F.col("event_id").cast("string"), F.lit("\tXS:i:5"))
    m = J.tag_map(tags)
    return table(spark, d, "events").select("event_id", F.size(m).alias("n"), F.regexp_extract(F.element_at(m, F.lit("NM")), "(i[0-9]+)$", 1).alias("nm"))


@query("SELECT read_index, '' AS read_name, CAST(8 AS INTEGER) AS n, '1E1E1E1E1E1E1E1E' AS qualities FROM reads", "reads")
def names_stripped(spark, d):
    reads = view(spark, d, "reads").withColumn("qualities", F.unhex(F.lit("00" * 8)))
    return N.constant_qualities(N.strip_names(reads)).select("read_index", "read_name", F.octet_length("qualities").alias("n"), F.hex("qualities").alias("qualities"))


@query("SELECT row_number() OVER (ORDER BY CASE WHEN spectrum_class = 5 THEN 1 ELSE 0 END, dataset_id, au_sequence) AS place, dataset_id, au_sequence FROM units QUALIFY place <= 300", "units")
def stream_head(spark, d):
    out = P.UnitFilter(max_au=300).on(view(spark, d, "units"))
    from pyspark.sql import Window

    w = Window.orderBy((F.col("spectrum_class") == 5).cast("int"), "dataset_id", "au_sequence")
    return out.select(F.row_number().over(w).cast("long").alias("place"), "dataset_id", "au_sequence")


@query("SELECT event_id, CASE WHEN event_id = 0 THEN 1 ELSE CAST(floor(log2(event_id) / 7) + 1 AS INTEGER) END AS n, event_id AS back FROM events")
def varints(spark, d):
    def run(batches):
        for b in batches:
            v = b.column(0).to_numpy()
            whole, size = C.varints(v)
            end = np.cumsum(size)
            back = [C.read_varint(whole[e - s : e].tobytes())[0] for s, e in zip(size, end, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int32)), pa.array(back, pa.int64())], ["event_id", "n", "back"])

    return table(spark, d, "events").select("event_id").mapInArrow(run, "event_id bigint, n int, back bigint")
