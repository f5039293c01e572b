import random
import uuid

import pytest
from pyspark.sql import functions as F

from omiclake.operators import access
from omiclake.sinks import jcamp
from omiclake.sources import imaging_xml, text_formats


@pytest.mark.parametrize("mode", ["PAC", "SQZ", "DIF"])
def test_jcamp_documents_round_trip(spark, mode):
    rng = random.Random(3)
    y = [round(rng.uniform(-5, 5), 4) for _ in range(47)] + [2.0] * 13
    x = [400 + 2.0 * i for i in range(len(y))]
    files = spark.createDataFrame([("p", jcamp.document("t", "INFRARED SPECTRUM", x, y, mode))], "path string, value string")
    got = text_formats.jcamp(files).first()
    assert (got["title"], got["data_type"]) == ("t", "INFRARED SPECTRUM")
    assert list(got["x"]) == pytest.approx(x) and list(got["y"]) == pytest.approx(y, abs=1e-5)


@pytest.mark.parametrize("continuous", [True, False])
def test_imzml_round_trip(spark, tmp_path, continuous):
    mz = [100.0, 200.5, 300.25]
    rows = [{"x": 1 + i % 2, "y": 1 + i // 2, "mz": mz if continuous else mz[: i + 1], "intensity": [float(i + k) for k in range(3 if continuous else i + 1)]} for i in range(3)]
    xml, ibd = imaging_xml.imzml_bytes(rows, continuous)
    (tmp_path / "a.imzML").write_text(xml)
    (tmp_path / "a.ibd").write_bytes(ibd)
    got = imaging_xml.imzml(spark, str(tmp_path)).orderBy("pixel_index").collect()
    assert [{k: r[k] for k in ("x", "y", "mz", "intensity")} for r in got] == rows and got[0]["z"] == 1
    with pytest.raises(ValueError, match="past"):
        list(imaging_xml.pixels(xml.encode(), ibd[:-4]))
    with pytest.raises(ValueError, match="identifiers"):
        list(imaging_xml.pixels(xml.encode(), uuid.uuid4().bytes + ibd[16:]))


def test_nmrml(spark, tmp_path):
    (tmp_path / "a.nmrML").write_text(imaging_xml.nmrml_text([0.0, 0.5, 1.0], [3.0, 2.0, 1.0]))
    got = imaging_xml.nmrml(spark, f"{tmp_path}/a.nmrML").first()
    assert (list(got["chemical_shift"]), list(got["intensity"])) == ([0.0, 0.5, 1.0], [3.0, 2.0, 1.0])


def test_parts_of_runs(spark):
    run = spark.createDataFrame([(i, [10.0 * i + k for k in range(4)]) for i in range(5)], "spectrum_index long, intensity array<double>")
    assert [r["value"] for r in access.channel_range(run, "intensity", 3, 6).collect()] == [3.0, 10.0, 11.0, 12.0, 13.0, 20.0]
    assert access.at_index(run, -2, "spectrum_index").first()["spectrum_index"] == 3
    cursor = access.Cursor(run, "spectrum_index")
    assert cursor.next()["spectrum_index"] == 0
    cursor.seek(4)
    assert cursor.next()["spectrum_index"] == 4 and not cursor.has_more()
    runs = spark.createDataFrame([("a", "ms"), ("b", "nmr")], "run_name string, spectrum_class string")
    assert access.one_run(runs, None, "nmr").first()["run_name"] == "b"
    with pytest.raises(ValueError, match="name a run"):
        access.one_run(runs)
    with pytest.raises(KeyError):
        access.one_run(runs, "c")


def test_tables_as_bytes_and_json(spark):
    df = spark.createDataFrame([(1, "a", 0.1), (2, None, None)], "i long, s string, v double")
    assert access.from_ipc(spark, access.to_ipc(df)).collect() == df.collect()
    assert access.canonical_json({"b": [1, 0.1, None], "a": {"y": "é", "x": True}}) == '{"a":{"x":true,"y":"\\u00e9"},"b":[1,0.10000000000000001,null]}'
    bad = spark.createDataFrame([("[1",), ('["a"]',), (None,)], "t string")
    assert [r[0] for r in bad.select(access.json_list(F.col("t"))).collect()] == [[], ["a"], []]
