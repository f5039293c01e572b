import gzip

import pytest
from pyspark.sql import functions as F

from omiclake.functions import canonical as C
from omiclake.functions import protection as E
from omiclake.operators import relations as R
from omiclake.operators.filters import UnitFilter
from omiclake.sources import bam, mztab, packets, registry, text_formats, units_codec

MZTAB = """MTD\tmzTab-version\t1.0
MTD\tms_run[1]-location\tfile:///a/run1.mzML
MTD\tassay[1]-sample_ref\ts1
MTD\tstudy_variable[1]-description\tgroup A
PRH\taccession\tprotein_abundance_assay[1]\tprotein_abundance_assay[2]
PRT\tP1\t1.5\tnull
PRT\tP2\t2\t3e2
PRT\tnull\t1\t1
PEH\tsequence\taccession\tcharge\tmass_to_charge\tretention_time\tpeptide_abundance_assay[1]
PEP\tAAK\tP1\t2\t400.5\t10.5|11\t7
SMH\tSML_ID\tdatabase_identifier\tchemical_formula\tchemical_name\tbest_id_confidence_value\tabundance_study_variable[1]\tabundance_study_variable[2]
SML\t1\tCHEBI:1\tC6H6\tbenzene\t0.8\t4\t5
SML\t2\tnull\tnull\tnull\t0.1\t4\t5
SFH\tSMF_ID\tSME_ID_REFS\tadduct_ion\texp_mass_to_charge\tcharge\tretention_time_in_seconds\tabundance_assay[1]
SMF\tF1\tE1|E2\t[M+H]+\t79.05\t1\t33\tnull
SEH\tSME_ID\tdatabase_identifier\tchemical_formula\tchemical_name\tspectra_ref\trank
SME\tE1\tCHEBI:1\tC6H6\tbenzene\tms_run[1]:index=3\t2
"""


@pytest.fixture(scope="module")
def lines(spark):
    return text_formats.numbered_lines(spark.createDataFrame([("f", MZTAB)], "path string, value string"))


def test_mztab_sections(lines):
    assert sorted((r["chemical_entity"], r["sample_ref"], r["abundance"]) for r in mztab.protein_quantities(lines).collect()) == [("P1", "s1", 1.5), ("P2", "assay_2", 300.0), ("P2", "s1", 2.0)]
    (m,) = mztab.small_molecules(lines).collect()
    assert (m["chemical_entity"], m["confidence_score"], m["run_name"], m["evidence_chain"]) == ("CHEBI:1", 0.8, "metabolomics", ["name=benzene", "formula=C6H6"])
    assert sorted((r["sample_ref"], r["abundance"]) for r in mztab.molecule_quantities(lines).collect()) == [("group A", 4.0), ("study_variable_2", 5.0)]
    (p,) = mztab.features(lines, "PEP").collect()
    assert (p["chemical_entity"], p["charge"], p["exp_mz"], p["retention_time"], p["abundances"]) == ("AAK", 2, 400.5, 10.5, {"s1": 7.0})
    (e,) = mztab.evidence(lines).collect()
    assert (e["sme_id"], e["confidence_score"]) == ("E1", 0.5)
    (f,) = R.backfill(mztab.features(lines, "SMF").drop("path", "line_no"), mztab.evidence(lines).select("sme_id", "chemical_entity", "rank")).collect()
    assert (f["chemical_entity"], f["adduct"], f["abundances"]) == ("CHEBI:1", "[M+H]+", {})


def test_mztab_document_reads_back(spark):
    ids = spark.createDataFrame([(0, "b", 4, "P1", 0.5), (1, "a", 7, "P2", 1e-7)], "ordinal bigint, run_name string, spectrum_index bigint, chemical_entity string, confidence_score double")
    q = spark.createDataFrame([(0, "P1", "", 1.0), (1, "P1", "", 1234567.0), (2, "P2", "x", None)], "ordinal bigint, chemical_entity string, sample_ref string, abundance double")
    doc = [r["value"] for r in mztab.document_lines(ids, q, "t").orderBy("ordinal").collect()]
    assert "PRT\tP1\t1.23457e+06\tnull" in doc and doc.index("MTD\tms_run[1]-location\tfile://b") < doc.index("MTD\tms_run[2]-location\tfile://a")
    back = text_formats.mztab_identifications(text_formats.numbered_lines(spark.createDataFrame([("f", "\n".join(doc))], "path string, value string")))
    assert sorted((r["run_name"], r["spectrum_index"], r["chemical_entity"], r["confidence_score"]) for r in back.collect()) == [("a", 7, "P2", 1e-07), ("b", 4, "P1", 0.5)]


READS = [
    {"read_name": "r1", "chromosome": "chr1", "position": 5, "mapping_quality": 60, "cigar": "3M1I2M", "sequence": "ACGTNA", "qualities": b"IIII!#", "flags": 99, "mate_chromosome": "=", "mate_position": 50, "template_length": 51, "tags": "NM:i:1\tXS:Z:a b\tXF:f:1.5\tXB:B:s,1,-2\tXA:A:q"},
    {"read_name": "r2", "chromosome": "*", "position": 0, "mapping_quality": 0, "cigar": "*", "sequence": "", "qualities": b"", "flags": 4, "mate_chromosome": "*", "mate_position": 0, "template_length": 0, "tags": ""},
    {"read_name": "r3", "chromosome": "chr2", "position": 9, "mapping_quality": 1, "cigar": "2S3M", "sequence": "TTTTT", "qualities": b"\xff" * 5, "flags": 16, "mate_chromosome": "chr1", "mate_position": 1, "template_length": -3, "tags": "NM:i:-7"},
]


def test_bam_comes_back(spark, tmp_path):
    data = bam.encoded(iter(READS), {"chr1": 1000, "chr2": 500})
    assert gzip.decompress(data)[:4] == b"BAM\1"
    (tmp_path / "a.bam").write_bytes(data)
    want = [READS[0] | {"mate_chromosome": "chr1"}, *READS[1:]]
    registry.register_sources(spark)
    for df in (registry.import_table(spark, f"{tmp_path}/a.bam"), spark.read.format("omic_bam").option("path", f"{tmp_path}/a.bam").load()):
        got = sorted((r.asDict() for r in df.collect()), key=lambda r: r["read_index"])
        assert [{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.items() if k in want[0]} for r in got] == want
        assert {r["run_name"] for r in got} == {"a"} and [r["read_index"] for r in got] == [0, 1, 2]
    with pytest.raises(ValueError):
        list(bam.blocks(b"nothing of it"))
    big = bam.encoded((READS[0] | {"read_name": f"n{i}"} for i in range(3000)), {"chr1": 1000})
    assert [r["read_name"] for r in bam.records(big, "x")] == [f"n{i}" for i in range(3000)]


def test_formats_by_name_and_ending(spark, tmp_path):
    assert registry.normalised("JCAMP-DX") == "jcamp" and registry.format_of("x/a.FQ.gz") == "fastq" and registry.format_of("a.imzML") == "imzml"
    with pytest.raises(ValueError):
        registry.normalised("nope")
    (tmp_path / "a.fa").write_text(">x one\nAC\nGT\n>y\nTT\n")
    reads = registry.import_table(spark, f"{tmp_path}/a.fa").orderBy("read_index").collect()
    assert [(r["read_index"], r["read_name"], r["sequence"]) for r in reads] == [(0, "x", "ACGT"), (1, "y", "TT")]
    table = spark.createDataFrame([(0, "x", "ACGT")], "ordinal bigint, name string, sequence string")
    registry.export_table(table, f"{tmp_path}/out.fa")
    assert spark.read.text(f"{tmp_path}/out.fa").count() == 2


def test_fastq_split_anywhere(spark, tmp_path):
    records = [(f"r{i}", "ACGTN"[: i % 6], "@I+5#"[: i % 6]) for i in range(3000)]
    (tmp_path / "a.fastq").write_text("".join(f"@{n} more\n{s}\n+\n{q}\n" for n, s, q in records))
    (tmp_path / "b.fastq").write_text("@z\nA\n+\nI\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = text_formats.fastq_lines(spark, f"{tmp_path}/*.fastq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    own = sorted((r["ordinal"], r["name"], r["sequence"], r["qualities"].decode()) for r in got if r["path"].endswith("a.fastq"))
    assert own == [(i, *r) for i, r in enumerate(records)] and len(got) == 3001
    (tmp_path / "c.fq").write_text("@z\nAC\n+\nI\n")
    with pytest.raises(Exception, match="isn't a FASTQ record"):
        text_formats.fastq_lines(spark, f"{tmp_path}/c.fq").collect()


UNITS = [
    {"spectrum_class": 0, "ms_level": 2, "retention_time": 1.5, "channels": [{"name": "mz", "precision": 1, "compression": 0, "n_elements": 2, "data": b"12345678"}]},
    {"spectrum_class": 4, "pixel_x": 3, "pixel_y": 4, "pixel_z": 0, "channels": []},
    {"spectrum_class": 5, "chromosome": "chrX", "position": 77, "mapping_quality": 9, "flags": 99, "channels": []},
]


def test_units_as_bytes_and_streams(spark):
    for u in UNITS:
        back = units_codec.unpack_unit(units_codec.pack_unit(u))
        assert all(back[k] == v for k, v in u.items())
    assert units_codec.unpack_unit(units_codec.pack_unit(UNITS[2]))["mate_position"] == -1
    with pytest.raises(ValueError):
        units_codec.unpack_unit(units_codec.pack_unit(UNITS[0])[:-3])
    rows = spark.createDataFrame([(0, 1, 2, 3.5)], "dataset_id bigint, au_sequence bigint, ms_level int, retention_time double")
    (back,) = units_codec.unpacked_units(units_codec.packed_units(rows)).collect()
    assert (back["ms_level"], back["retention_time"], back["chromosome"]) == (2, 3.5, None)
    samples = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "id bigint, name string")
    data = b"".join(units_codec.stream_bytes(rows, {"samples": samples}))
    found = packets.Parser().feed(data)
    assert sorted(units_codec.tables_of(found)["samples"]["name"].to_pylist()) == [f"s{i}" for i in range(5)]
    assert [units_codec.unpack_unit(p)["ms_level"] for kind, _, _, p in found if kind == packets.UNIT] == [2]


def test_client_filters_come_back():
    f = UnitFilter(rt_min=1.0, ms_level=2, chromosome="chr1", max_au=5)
    assert UnitFilter.from_json(f.to_json()) == f and UnitFilter.from_json("{}") == UnitFilter()


def test_canonical_bytes_signatures_and_sealed_rows(spark):
    df = spark.createDataFrame([(2, "é", 1.5, [1, 2]), (1, None, -0.5, [])], "a int, b string, c double, d array<int>")
    rows = {r["a"]: bytes(r["canonical"]) for r in C.canonical_bytes(df, ["a", "b", "c", "d"]).collect()}
    import struct

    assert rows[2] == struct.pack("<i", 2) + struct.pack("<I", 2) + "é".encode() + struct.pack("<d", 1.5) + struct.pack("<ii", 1, 2)
    assert rows[1] == struct.pack("<i", 1) + struct.pack("<I", 0) + struct.pack("<d", -0.5)
    key, sig = b"k" * 32, C.signature(df, ["a", "b"], ["a"], b"k" * 32)
    assert sig == C.signature(df.repartition(3), ["a", "b"], ["a"], key) and C.is_signed(df, ["a", "b"], ["a"], key, sig) and not C.is_signed(df.where("a = 1"), ["a", "b"], ["a"], key, sig)
    signed = E.signed(spark.createDataFrame([(b"x",), (None,)], "x binary"), "x", key)
    assert sorted(r["ok"] for r in C.verified(signed, "x", key).collect()) == [False, True]
    assert not any(r["ok"] for r in C.verified(signed, "x", b"other").collect())
    boxes = C.sealed_table(df, key, "t").persist()
    assert sorted(r["a"] for r in C.opened_table(boxes, key, "t", df.schema).collect()) == [1, 2]
    with pytest.raises(Exception):
        C.opened_table(boxes, key, "u", df.schema).collect()
    units = spark.createDataFrame([(0, 1, 2, 350.25)], "dataset_id bigint, au_sequence bigint, ms_level int, precursor_mz double")
    iv, aad = F.lit(bytes(12)), F.lit(b"aad")
    hidden = C.sealed_headers(units, F.lit(key), iv, aad)
    assert "ms_level" not in hidden.columns and hidden.select(F.octet_length("header.ciphertext")).first()[0] == 36
    (back,) = C.opened_headers(hidden, F.lit(key), aad).collect()
    assert (back["ms_level"], back["precursor_mz"], back["ion_mobility"]) == (2, 350.25, 0.0)
