"""Every catalogued query against the SQL that gives its rows."""

import math

import duckdb
import pytest

from omiclake.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def key(row):
    return [(x is None, str(x)) for x in row]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    r = db.sql(catalog.ORACLES[name])
    at = [r.columns.index(c) for c in columns]
    assert sorted(r.columns) == columns
    want = sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=1e-9) for x, y in zip(a, b, strict=True)), (a, b)


def test_index_query_pushes_its_filters_and_prunes_columns(spark):
    plan = catalog.region_half_open(spark, FOLDER)._jdf.queryExecution().toString()
    read = plan[plan.rindex("ReadSchema") :].split("\n")[0]
    assert "o_orderkey" in read and "o_totalprice" not in read


def test_entry_point_works_without_the_llm_part():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    code = "import sys; sys.modules['omiclake.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'index_query' in q and 'pipeline' not in q; assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_the_sort_gives_every_read_its_place(spark):
    got = {r["read_index"]: r["place"] for r in catalog.sam_sort(spark, FOLDER).collect()}
    assert len(got) == catalog.view(spark, FOLDER, "reads").count() > 500
    assert sorted(got.values()) == list(range(1, len(got) + 1))


def test_mask_regions_come_from_all_suppliers(spark):
    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = sorted(r[0] for r in catalog.mask_regions_overlap(spark, folder).collect())
    assert got == sorted(r[0] for r in c.sql(catalog.ORACLES["mask_regions_overlap"]).fetchall())
    few = catalog.ORACLES["mask_regions_overlap"].replace("FROM supplier)", "FROM supplier WHERE s_suppkey < 20)")
    assert few != catalog.ORACLES["mask_regions_overlap"] and len(got) > len(c.sql(few).fetchall())
