import random
import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from omiclake.functions import codecs, protection
from omiclake.operators import analysis, anonymise, cohort, filters, projections, relations
from omiclake.sinks import text_lines
from omiclake.sources import packets, spectra_xml, text_formats
from omiclake.streaming import units

NAN = float("nan")


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_nan_is_outside_a_query_and_inside_a_stream_filter(spark):
    df = spark.createDataFrame([(1, 5.0), (2, NAN), (3, 9.0), (4, 10.0)], "id int, retention_time double")
    assert ids(filters.IndexQuery().with_retention_time_range(5.0, 9.0).on(df)) == [1, 3]
    assert ids(df.where(filters.UnitFilter(rt_min=5.0, rt_max=9.0).column())) == [1, 2, 3]
    assert ids(filters.IndexQuery().on(df)) == [1, 2, 3, 4]
    peaks = spark.createDataFrame([(1, NAN), (2, 3.0)], "id int, base_peak_intensity double")
    assert ids(filters.IndexQuery().with_base_peak_intensity_at_least(1.0).on(peaks)) == [2]


def test_setters_give_new_queries_and_the_last_holds():
    a = filters.IndexQuery().with_ms_level(1)
    assert a.with_ms_level(2).ms_level == 2 and a.ms_level == 1


def test_filters_from_json():
    f = filters.UnitFilter.from_json
    assert f(None) == f("nonsense") == f("[1]") == filters.UnitFilter()
    assert f('{"filters": {"rt_min": 1, "polarity": "negative", "x": 1}}') == filters.UnitFilter(rt_min=1.0, polarity=1)
    with pytest.raises(ValueError):
        filters.UnitFilter.from_dict({"ms_level": "two"})
    assert filters.parse_pairs(["a=1", "b=1.5", "c=x=y"]) == {"a": 1, "b": 1.5, "c": "x=y"}
    with pytest.raises(ValueError):
        filters.parse_pairs(["a"])


def test_chromosome_filter_takes_genomic_units_only(spark):
    df = spark.createDataFrame([(1, 0, "chr1", 5), (2, 5, "chr1", 5), (3, 5, "chr2", 5)], "id int, spectrum_class int, chromosome string, position long")
    assert ids(df.where(filters.UnitFilter(chromosome="chr1").column())) == [2]


def test_partial_pixels_raise(spark):
    df = spark.createDataFrame([(1, 2, 3), (None, None, None)], "x int, y int, z int")
    assert [r[0] for r in df.select(filters.pixel_coordinates(F.col("x"), F.col("y"), F.col("z"))).collect()] == [(1, 2, 3), None]
    bad = spark.createDataFrame([(1, None, 3)], "x int, y int, z int")
    with pytest.raises(Exception, match="pixel"):
        bad.select(filters.pixel_coordinates(F.col("x"), F.col("y"), F.col("z"))).collect()


def test_cohort_rules_and_pages(spark):
    p = cohort.phenotype("bmi", "gt", 30.0)
    for bad in (lambda: ~p, lambda: p | p, lambda: ~(cohort.subject("a", "eq", 1) & p), lambda: cohort.All(()), lambda: cohort.subject("a", "in", [])):
        with pytest.raises(ValueError):
            bad()
    rows = [(i, None if i % 4 == 0 else i % 3) for i in range(23)]
    t = {"samples": spark.createDataFrame(rows, "sample_id long, rank int")}
    for order in ((("rank", True),), (("rank", False),), ()):
        seen, cursor = [], None
        while True:
            page, cursor = cohort.Cohort(t, "samples", None, order, 5, cursor).fetch()
            seen += [r["sample_id"] for r in page]
            if cursor is None:
                break
        assert sorted(seen) == list(range(23)) and len(seen) == 23
    with pytest.raises(ValueError):
        cohort.Cohort(t, "samples", None, (), 1001)
    assert cohort.Cohort(t, "samples", cohort.sample("rank", "ne", 1)).count().first()["n"] == sum(r is not None and r != 1 for _, r in rows)


def test_masking_by_overlap(spark):
    reads = spark.createDataFrame([(0, "c", 90, "20M"), (1, "c", 90, "5M20I5M"), (2, "c", 109, ""), (3, "c", 110, "*"), (4, "d", 90, "20M"), (5, "c", 80, "3M10000N3M")], "read_index long, chromosome string, position long, cigar string")
    regions = spark.createDataFrame([("c", 100, 109), ("c", 105, 106)], "chromosome string, start long, end long")
    assert ids(anonymise.masked_reads(reads, regions, bin_size=16), "read_index") == [0, 2, 5]


def joined_rows(df):
    """Rows that each join of a plan gave, after it ran."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName():
            out.append(p.metrics().apply("numOutputRows").value())
        inner = p.executedPlan() if p.nodeName() == "AdaptiveSparkPlan" else p.plan() if p.nodeName().endswith("QueryStage") else None
        todo += [inner] if inner else [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_masking_matches_brute_force_and_meets_a_bin_once(spark):
    rng = random.Random(5)
    cigar = lambda: rng.choice(["*", "7M", "3M40N2M", "30M2D", "9S4M"])
    reads = spark.createDataFrame([(i, rng.choice("cd"), rng.randrange(900), cigar()) for i in range(400)] + [(400, None, 5, "9M")], "read_index long, chromosome string, position long, cigar string")
    some = [("c", s := rng.randrange(900), s + rng.choice([0, 3, 9, -4, 120])) for _ in range(40)] + [("d", 500, 501), ("c", None, 4), ("c", 4, None)]
    regions = lambda rows: spark.createDataFrame(rows, "chromosome string, start long, end long")
    for size in (1, 16, 1 << 14):
        plain = reads.join(regions(some), "chromosome").where(anonymise.overlaps(F.col("position"), F.col("cigar"), F.col("start"), F.col("end")))
        want = sorted({r["read_index"] for r in plain.collect()})
        assert ids(anonymise.masked_reads(reads, regions(some), size), "read_index") == want and 50 < len(want) < 350
    many = anonymise.masked_reads(reads, regions([(c, i, 1000 - i) for c in "cd" for i in range(300)]))
    assert len(many.collect()) == 400 and max(joined_rows(many)) <= 400


def test_correlations_match_whole_matrices_and_are_cut_by_column_and_frequency(spark, monkeypatch):
    monkeypatch.setattr(analysis, "FREQUENCIES", 8)
    rng = np.random.default_rng(2)
    sizes = {"a": (2, 3), "b": (33, 3), "c": (50, 1), None: (7, 2)}
    data = {g: rng.normal(size=s) for g, s in sizes.items()}
    rows = [(g, k, x.tolist()) for g, a in data.items() for k, x in enumerate(a)]
    random.Random(1).shuffle(rows)
    spectra = spark.createDataFrame(rows, "run string, at long, intensity array<double>").repartition(3)
    for mean in (None, 0.25):
        for g, a in data.items():
            own = spectra.where(F.col("run").eqNullSafe(g))
            m, n = a.shape
            d = a - (a.mean(axis=0) if mean is None else mean)
            gap = np.arange(m)[None, :] - np.arange(m)[:, None]
            noda = np.divide(1, np.pi * gap, out=np.zeros((m, m)), where=gap != 0)
            got = {(r["i"], r["j"]): (r["synchronous"], r["asynchronous"]) for r in analysis.correlation_2d(own, "run", "at", reference=None if mean is None else [mean] * n).collect()}
            want = {(i, j): (s, p) for i in range(n) for j in range(n) for s, p in [((d.T @ d / (m - 1))[i, j], (d.T @ noda @ d / (m - 1))[i, j])]}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert analysis.correlation_2d(spectra, "run", "at").count() == sum(n * n for _, n in sizes.values())
    for bad in ([("x", 0, [1.0])], [("x", 0, [1.0, 2.0]), ("x", 1, [1.0])], [("x", k, [1.0] * (2 if k < 20_000 else 3)) for k in range(20_003)]):
        with pytest.raises(Exception, match="equal length"):
            analysis.correlation_2d(spark.createDataFrame(bad, spectra.schema), "run", "at").collect()


def test_a_long_group_needs_no_square_matrix(spark):
    rows = spark.range(150_000).select(F.lit("x").alias("run"), "id", F.array(F.sin(F.col("id") / 9), F.cos(F.col("id") / 9)).alias("intensity"))
    got = {(r["i"], r["j"]): r["asynchronous"] for r in analysis.correlation_2d(rows, "run", "id").collect()}  # 180 GB as a matrix
    assert got[0, 0] == pytest.approx(0, abs=1e-9) and got[0, 1] == pytest.approx(-got[1, 0]) and got[0, 1] == pytest.approx(-(1 - 1 / (9 * np.pi)) / 2, abs=1e-3)


def test_interning_and_concatenation(spark):
    df = spark.createDataFrame([("b", 0), ("a", 1), ("*", 2), ("b", 3), ("", 4)], "chromosome string, read_index long")
    assert {r["chromosome"]: r["id"] for r in relations.interned(df, "chromosome", "read_index").collect()} == {"b": 0, "a": 1, "*": 65535, "": 65535}
    both = relations.concat_runs([df, df.withColumn("tags", F.lit("x"))])
    assert ids(both, "read_index") == list(range(10))
    assert sorted(r["tags"] for r in both.collect()) == [""] * 5 + ["x"] * 5
    assert ids(relations.slice_run(both, 3, 6), "read_index") == [0, 1, 2]


def test_block_lookup_before_the_first_block(spark):
    reads = spark.createDataFrame([("r", i) for i in range(6)], "run_name string, read_index long")
    blocks = spark.createDataFrame([("r", 0, 2, 2), ("r", 1, 5, 9)], "run_name string, block int, read_start long, n_reads long")
    assert [r["block"] for r in projections.block_of(reads, blocks).orderBy("read_index").collect()] == [None, None, 0, 0, None, 1]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.text("ACGTN", max_size=300))
def test_codecs_round_trip(data, bases):
    assert codecs.unpack_bases(codecs.pack_bases(data)) == data
    assert codecs.unpack_bases(codecs.pack_bases(bases.encode())) == bases.encode()
    binned = codecs.unpack_qualities(codecs.pack_qualities(data))
    assert codecs.unpack_qualities(codecs.pack_qualities(binned)) == binned and len(binned) == len(data)


@given(st.integers(0, 2**63))
def test_varint(n):
    assert codecs.read_varint(codecs.varint(n)) == (n, len(codecs.varint(n)))


def test_jcamp_forms_agree():
    plain = text_formats.jcamp_values(["0 100 103 103 103 99", "5 98"])
    squeezed = text_formats.jcamp_values(["0 A00A03A03A03I9", "5 I8"])
    packed = text_formats.jcamp_values(["0 A00L%Tn", "5 I8j"])
    assert plain == squeezed == [100, 103, 103, 103, 99, 98]
    assert packed == [100, 103, 103, 103, 98, 97]


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\nGG\n")
    assert [tuple(r) for r in text_formats.fasta(spark, f"{tmp_path}/a.fa").collect()] == [("one", "ACGTAC"), ("two", "GG")]
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\nIIII\n\n@r2\nA\n+r2\n!\n")
    got = text_formats.fastq(spark, f"{tmp_path}/a.fq").collect()
    assert [(r["ordinal"], r["name"], r["sequence"], bytes(r["qualities"])) for r in got] == [(0, "r1", "ACGT", b"IIII"), (1, "r2", "A", b"!")]
    (tmp_path / "bad.fq").write_text("@r1\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="record"):
        text_formats.fastq(spark, f"{tmp_path}/bad.fq").collect()


def test_sam_round_trip(spark):
    lines = ["@HD\tVN:1.6", "r1\t99\tchr1\t100\t60\t4M\t=\t200\t104\tACGT\tIIII\tNM:i:0\tXX:Z:a", "r2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"]
    df = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    reads = text_formats.sam(df)
    assert [(r["mate_chromosome"], r["sequence"], bytes(r["qualities"])) for r in reads.collect()] == [("chr1", "ACGT", b"IIII"), ("*", "", b"")]
    assert [r["value"] for r in text_lines.sam_lines(reads).orderBy("read_index").collect()] == lines[1:]


def test_mztab_sections(spark):
    text = "MTD\tmzTab-version\t1.0\nMTD\tms_run[1]-location\tfile:///x/run_a.mzML\nPSH\tsequence\taccession\tsearch_engine_score[1]\tspectra_ref\nPSM\tPEP\tnull\tnull\tms_run[1]:index=7\nPSM\tPEQ\tP1\t0.5\tms_run[2]:scan=3\n"
    lines = text_formats.numbered_lines(spark.createDataFrame([("f", text)], "path string, value string"))
    got = text_formats.mztab_identifications(lines).orderBy("line_no").collect()
    assert [tuple(r)[2:] for r in got] == [("run_a", 7, "PEP", 0.0), ("run_2", 3, "P1", 0.5)]


def test_mzml_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"ms_level": 1 + i % 2, "polarity": i % 3 - 1, "retention_time": i * 0.5, "precursor_mz": 300.25 * (i % 2), "precursor_charge": 2 * (i % 2), "mz": [rng.random() for _ in range(i)], "intensity": [rng.random() for _ in range(i)]} for i in range(5)]
    for compress in (True, False):
        (tmp_path / f"{compress}.mzML").write_text(spectra_xml.mzml_text(rows, compress))
        got = spectra_xml.mzml(spark, f"{tmp_path}/{compress}.mzML").orderBy("spectrum_index").collect()
        assert [{k: r[k] for k in rows[0]} for r in got] == rows
        assert got[0]["base_peak_intensity"] == 0.0 and got[4]["base_peak_intensity"] == max(rows[4]["intensity"])


def test_packets(spark, tmp_path):
    assert packets.crc32c(b"123456789") == 0xE3069283
    data = packets.packet(packets.START, 0, 0, b"head") + b"".join(packets.packet(packets.UNIT, 1, i, bytes([i]) * i) for i in (1, 3, 7)) + packets.packet(packets.END, 0, 0, b"") + b"junk"
    parser, got = packets.Parser(), []
    for i in range(0, len(data), 5):
        got += parser.feed(data[i : i + 5])
    parser.finish()
    assert [(k, s, len(p)) for k, _, s, p in got] == [(1, 0, 4), (3, 1, 1), (3, 3, 3), (3, 7, 7), (255, 0, 0)]
    (tmp_path / "s.bin").write_bytes(data)
    assert packets.packets(spark, f"{tmp_path}/s.bin").count() == 5
    with pytest.raises(ValueError, match="checksum"):
        packets.Parser().feed(data[:26] + b"X" + data[27:])
    with pytest.raises(ValueError, match="no end"):
        packets.Parser().finish()
    with pytest.raises(ValueError, match="grow"):
        packets.Parser().feed(packets.packet(packets.START, 0, 0, b"") + packets.packet(packets.UNIT, 1, 2, b"") * 2)


def test_stream_checks_sequences(spark, tmp_path):
    pd.DataFrame({"dataset_id": [1, 1, 2, 1, 2], "au_sequence": [1, 5, 3, 5, 4], "arrival": range(5)}).to_parquet(tmp_path / "a.parquet")
    rows = spark.readStream.schema("dataset_id bigint, au_sequence bigint, arrival bigint").parquet(str(tmp_path))
    q = units.sequence_checked(rows).writeStream.format("memory").queryName("checked").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("checked").collect())) == [(1, 1, True), (1, 5, False), (1, 5, True), (2, 3, True), (2, 4, True)]


def test_region_keys_leave_others_clear(spark):
    rows = [(1, 1, "seq", "chr1", b"ACGT"), (1, 2, "seq", "chr2", b"TT")]
    df = spark.createDataFrame(rows, "dataset_id long, au_sequence long, channel string, chromosome string, data binary")
    keys = spark.createDataFrame([("chr1", bytes(16))], "chromosome string, key binary")
    out = protection.sealed_by_region(df, keys, F.lit(bytes(12)))
    aad = protection.channel_aad(F.col("dataset_id"), F.col("au_sequence"), F.col("channel"))
    got = out.withColumn("aad", aad).select("chromosome", "box", "aad", protection.opened(F.col("box"), F.lit(bytes(16)), aad).alias("plain")).collect()
    assert {r["chromosome"]: bytes(r["plain"]) for r in got} == {"chr1": b"ACGT", "chr2": b"TT"}
    assert {r["chromosome"]: len(r["box"]["iv"]) for r in got} == {"chr1": 12, "chr2": 0}
    assert bytes(got[0]["aad"])[:6] in (struct.pack("<HI", 1, 1), struct.pack("<HI", 1, 2))


def test_seeded_qualities_repeat(spark):
    reads = spark.createDataFrame([("a", 1, b"xx"), ("a", 0, b"yyyy"), ("b", 0, None)], "run_name string, read_index long, qualities binary")
    one, two = ({(r[0], r[1]): bytes(r[2]) for r in anonymise.seeded_qualities(d, 5).collect()} for d in (reads, reads.repartition(3)))
    assert one == two and one["a", 0] == np.random.default_rng(5).integers(0, 94, 4, dtype=np.uint8).tobytes()


def test_code_points_and_letters_are_whole_and_taken_in_batches(spark):
    texts = ["", "abc", "\u00e9\u4e2d\U0001f600z", None, "\x00x\n", "N" * 70_000]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", codecs.code_points(F.col("text")).alias("x"), codecs.letters(F.col("text"), "ACGTN").alias("t")).collect()
    assert {r["id"]: (r["x"], r["t"]) for r in got} == {i: ([ord(c) for c in t or ""], "".join("ACGTN"[ord(c) % 5] for c in t or "")) for i, t in enumerate(texts)}


def test_packable_fraction_splits_no_text_into_characters(spark):
    from omiclake.plans import catalog

    for name in ("packable_fraction", "quality_binned", "phred_detect"):
        assert "split(" not in catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
