import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from omiclake.functions import codecs, entropy
from omiclake.operators import anonymise
from omiclake.sinks import jcamp


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=400), st.text("ab", max_size=400).map(str.encode)))
def test_byte_codecs_come_back(data):
    for number in (0, 1, 4, 5, 6):
        c = entropy.CODECS[number]
        assert c.decode(c.encode(data)) == data


def test_rans_is_near_the_entropy():
    rng = np.random.default_rng(1)
    x = rng.choice([65, 66, 67], 20_000, p=[0.9, 0.08, 0.02]).astype(np.uint8).tobytes()
    p = np.bincount(np.frombuffer(x, np.uint8)) / len(x)
    bits = -sum(q * np.log2(q) for q in p if q) * len(x) / 8
    assert len(entropy.rans_encode(x)) < 1.05 * bits + 120
    steps = np.resize(np.frombuffer(b"ACGT", np.uint8), 5000).tobytes()
    assert len(entropy.rans_encode(steps, 1)) < 200 < len(entropy.rans_encode(steps))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62 - 1), max_size=80), st.lists(st.floats(), max_size=80), st.integers(1, 30))
def test_numbers_come_back_bit_by_bit(longs, doubles, block):
    v = np.array(longs, np.int64)
    assert (entropy.delta_decode(entropy.delta_encode(v)) == v).all()
    d = np.array(doubles, "<f8")
    packed = entropy.floats_encode(d, block)
    assert entropy.floats_decode(packed).tobytes() == d.tobytes()
    n = len(entropy.floats_blocks(packed))
    assert n == -(-len(d) // block) and (n == 0 or entropy.floats_decode(packed, range(n - 1, n)).tobytes() == d[(n - 1) * block :].tobytes())


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTacgtNnRy", max_size=300), st.lists(st.integers(0, 2**63), max_size=60), st.binary(max_size=300))
def test_references_varints_and_exceptions(sequence, numbers, data):
    assert entropy.unpacked_reference(entropy.packed_reference(sequence)) == sequence
    whole, size = codecs.varints(np.array(numbers, np.uint64))
    assert whole.tobytes() == b"".join(map(codecs.varint, numbers)) and size.tolist() == [len(codecs.varint(n)) for n in numbers]
    spread = b"A" * 300 + data + b"C" * 20_000 + data
    assert codecs.unpack_bases(codecs.pack_bases(spread)) == spread and codecs.unpack_bases(codecs.pack_bases(data)) == data


def test_columns_go_through_codecs(spark):
    df = spark.createDataFrame([(1, b"ACGTN"), (2, None), (3, b"")], "k bigint, x binary")
    packed = entropy.coded(df, "x", 5)
    assert sorted(map(tuple, entropy.coded(packed, "x", 5, decode=True).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(KeyError):
        entropy.coded(df, "x", 99)


def test_jcamp_rounds_halves_away_from_zero_and_powers_of_ten_stay():
    assert jcamp.encoded([0.5, 1.5, 2.5, -0.5, -2.5], 0, 1, 1.0, "PAC") == ["0+1+2+3-1-3"]
    assert jcamp.y_factor([1.0]) == pytest.approx(1e-7) and jcamp.y_factor([999.0]) == pytest.approx(1e-4) and jcamp.y_factor([0.0]) == 1.0


def test_masking_keeps_runs_apart(spark):
    reads = spark.createDataFrame([("a", 0, "chr1", 10, "4M", "ACGT", b"1234"), ("b", 0, "chr9", 10, "4M", "GGGG", b"1234")], "run_name string, read_index bigint, chromosome string, position bigint, cigar string, sequence string, qualities binary")
    regions = spark.createDataFrame([("chr1", 5, 12)], "chromosome string, start bigint, end bigint")
    assert sorted((r["run_name"], r["sequence"]) for r in anonymise.mask_regions(reads, regions).collect()) == [("a", "NNNN"), ("b", "GGGG")]


def test_numpress_and_quantile_rows(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],), ([],), (None,)], "x array<double>")
    back = df.select(codecs.numpress_values(codecs.numpress_deltas(F.col("x"), 1000.0), 1000.0).alias("y"))
    assert [r["y"] for r in back.collect()] == [[1.0, 2.0, 4.0], [], None]
