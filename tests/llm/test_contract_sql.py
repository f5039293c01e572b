"""The columns that SQL can give, against that SQL."""

import math
import zlib

import duckdb
import pytest

from omiclake.llm import contract

FOLDER = "/root/testdata/sf0.001"


def db(path: str):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    return c


def same(spark, name: str, path: str) -> None:
    df = contract.QUERIES[name](spark, path)
    got = sorted((tuple(r) for r in df.collect()), key=str)
    r = db(path).sql(contract.ORACLE_SQL[name])
    assert sorted(r.columns) == sorted(df.columns)
    at = [r.columns.index(c) for c in df.columns]
    want = sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=str)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=2e-3) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(contract.QUERIES))
def test_contract_columns(spark, name):
    same(spark, name, FOLDER)


def test_targets_where_caps_bind(spark, tmp_path):
    rows = [(1, "a " * 1000, "x"), (2, "b " * 10, "y"), (3, "c c", "z"), (4, None, None), (5, "d " * 40, "w")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1] for r in c.sql(f"SELECT doc_id, target FROM ({contract.ORACLE_SQL['mix_targets']})").fetchall()}
    got = {r["doc_id"]: r["target"] for r in contract.mix_targets(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want)
    assert got[3] == 6 and got[4] == 0 and sum(got.values()) == pytest.approx(1052)


def test_the_bitwise_checksum():
    c = duckdb.connect()
    for i in (0, 7, 123456789, 2**53, -5):
        assert c.sql(f"SELECT {contract.CRC} FROM (SELECT {i}::BIGINT AS doc_id)").fetchall() == [(zlib.crc32(str(i).encode()),)]


def test_edits_take_no_words_apart(spark):
    df = contract.fingerprint_edits(spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "xxhash64(" not in plan  # a signature's words
