import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from omiclake.operators import blocks as B
from omiclake.store import container as K


def values(spark, xs):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "idx bigint, value double")


def flat(df):
    return [r["value"] for r in df.orderBy("idx").collect()]


def test_container_tree_attributes_and_slices(spark, tmp_path):
    c = K.open_container(spark, f"parquet://{tmp_path}/c")
    c.create_dataset("/runs/a/mz", values(spark, range(10)))
    c.create_group("/runs/b")
    assert c.child_names("/") == ["runs"] and c.child_names("/runs") == ["a", "b"] and c.child_names("/runs/a") == ["mz"]
    c.set_attribute("/runs/a", "polarity", 1)
    c.set_attribute("/runs/a", "title", "x")
    assert c.attributes("/runs/a") == {"polarity": 1, "title": "x"} and c.get_attribute("/runs/a", "polarity") == 1
    c.append("/runs/a/mz", values(spark, [100, 101]))
    c.write_slice("/runs/a/mz", 3, values(spark, [-3, -4]))
    assert flat(c.read("/runs/a/mz")) == [0, 1, 2, -3, -4, 5, 6, 7, 8, 9, 100, 101]
    assert flat(c.read("/runs/a/mz", 2, 5)) == [2, -3, -4]
    with pytest.raises(IndexError):
        c.write_slice("/runs/a/mz", 11, values(spark, [0, 0]))
    with pytest.raises(ValueError):
        c.create_dataset("/runs/a/mz", values(spark, []))
    c.delete_child("/runs/a")
    assert c.child_names("/runs") == ["b"]
    with pytest.raises(KeyError):
        c.read("/runs/a/mz")
    c.create_dataset("/cube", values(spark, range(24)), (2, 3, 4))
    got = {(r["i0"], r["i1"], r["i2"]): r["value"] for r in c.read_box("/cube", (0, 1, 2), (2, 3, 4)).collect()}
    x = np.arange(24).reshape(2, 3, 4)
    assert got == {(i, j, k): x[i, j, k] for i in range(2) for j in (1, 2) for k in (2, 3)}
    with pytest.raises(ValueError):
        c.append("/cube", values(spark, [1]))


def test_spectra_come_back_from_index_and_chunks(spark):
    rng = random.Random(1)
    rows = [(i, [float(i * 100 + k) for k in range(n)], [float(-k) for k in range(n)]) for i, n in enumerate([3, 0, 17, 5, 0, 1, 40] + [rng.randint(0, 9) for _ in range(20)])]
    spectra = spark.createDataFrame(rows, "spectrum_index bigint, mz array<double>, intensity array<double>")
    index, chunks = K.signal_chunks(spectra, ["mz", "intensity"], size=8)
    assert chunks.agg(F.max(F.size("mz"))).first()[0] == 8
    back = K.assembled(index, chunks, ["mz", "intensity"], size=8)
    assert sorted(map(tuple, back.collect())) == rows


def test_blocks_columns_budget_and_progress(spark):
    run = spark.range(0, 1000, 1, 7).select(F.col("id").alias("spectrum_index"), (F.col("id") * 2).alias("x"))
    total = lambda block, t: pa.table({"block": pa.array([block]), "n": pa.array([t.num_rows]), "first": pa.array([t["x"][0].as_py()])})
    got = sorted(map(tuple, B.for_each_block(run, total, "block bigint, n bigint, first bigint", size=100, start=150, stop=420).collect()))
    assert got == [(1, 50, 300), (2, 100, 400), (3, 100, 600), (4, 20, 800)]
    assert B.block_column(run, "x", 9, size=100).to_pylist() == list(range(1800, 2000, 2))
    sizes = spark.range(50).select(F.col("id").alias("read_index"), (F.col("id") % 7 + 1).alias("bytes"))
    blocks = B.block_budget(sizes, 20).orderBy("first").collect()
    assert sum(r["rows"] for r in blocks) == 50 and all(r["bytes"] <= 27 for r in blocks)
    done, seen = [], []
    B.Progress(lambda a, b: done.append((a, b))).run(run, lambda part: seen.append(part.count()), parts=3)
    assert done == [(1, 3), (2, 3), (3, 3)] and sum(seen) == 1000


def test_units_references_and_axes(spark):
    units = spark.createDataFrame([(0, 1), (0, 0), (1, 0)], "dataset_id bigint, au_sequence bigint")

    class Seen(list):
        def unit(self, r):
            self.append(tuple(r))

        def end(self):
            self.append("end")

    B.visited(units, seen := Seen())
    assert seen == [(0, 0), (0, 1), (1, 0), "end"]
    both = B.stream_union(units, units).select("dataset_id").distinct().collect()
    assert sorted(r[0] for r in both) == [0, 1, 2, 3]
    bases = "".join(random.Random(3).choices("ACGT", k=95))
    parts = B.reference_parts(spark.createDataFrame([("chr1", bases), ("chr2", "")], "name string, sequence string"), "ref", 10)
    assert parts.count() == 11
    for a, b in ((0, 95), (7, 33), (20, 30), (94, 95)):
        assert B.reference_slice(parts, "ref", "chr1", a, b, 10).first()[0] == bases[a:b]
    reads = spark.createDataFrame([("ACGT", "4M"), ("", "3M2D4S1I"), (None, None), ("", "*")], "sequence string, cigar string")
    assert [r[0] for r in reads.select(B.read_length(F.col("sequence"), F.col("cigar"))).collect()] == [4, 8, 0, 0]
    nmr = spark.createDataFrame([("r", [1.0, 2.0]), ("r", [3.0, 4.0]), ("s", [1.0])], "run_name string, intensity array<double>")
    assert sorted(map(tuple, B.nmr_shape(nmr).collect())) == [("r", 2, 2), ("s", 1, 1)]
    assert spark.range(1).select(B.spectral_axis(10.0, 20.0, 5)).first()[0] == [10.0, 12.5, 15.0, 17.5, 20.0]
    runs = spark.createDataFrame([("a", "NMR"), ("b", "MS")], "run_name string, modality string")
    assert [r[0] for r in B.runs_of_modality(runs, "nmr").select("run_name").collect()] == ["a"]
    images = spark.createDataFrame([("i", "raman", 1)], "image_name string, kind string, x int")
    assert B.image_of_kind(images, "raman").count() == 1
    with pytest.raises(KeyError):
        B.image_of_kind(images, "ir")


def test_pieces_make_the_parts_and_slices_of_their_sequence(spark):
    names = ["ACGT" * 9, "", "T", None, "GATTACA", "C" * 23, "G"]
    pieces = spark.createDataFrame([(7 * k - 3, t) for k, t in enumerate(names)][::-1], "place long, sequence string")
    bases = "".join(t or "" for t in names)
    whole = B.reference_parts(spark.createDataFrame([("c", bases)], "name string, sequence string"), "ref", 10)
    parts = B.joined_parts(pieces, "ref", "c", "place", 10)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    ranges = [(0, 5), (8, 31), (20, 20), (60, 900), (500, 510), (0, len(bases))]
    got = B.reference_slices(parts, "ref", "c", spark.createDataFrame(ranges, "start long, stop long"), 10).collect()
    assert {(r["start"], r["stop"]): r["bases"] for r in got} == {(a, b): bases[a:b] for a, b in ranges}
    assert B.joined_parts(pieces.where("place > 900"), "ref", "c", "place", 10).collect() == []


def test_lookups_scan_names_a_fixed_number_of_times_and_join_no_whole_sequence(spark):
    from omiclake.plans import catalog_more

    plan = catalog_more.reference_lookups(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [p_partkey") <= 2 and "Aggregate [array_join" not in plan
