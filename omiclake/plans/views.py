"""Domain tables over the test tables: each as a DataFrame and as SQL that DuckDB runs to the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (SQL for Spark over the raw tables, SQL for DuckDB); the latter only where it differs.
EPOCH = 1704067200000000

_INDEX = """SELECT event_type AS run_name, event_id AS spectrum_index, ({us} - 1704067200000000) / CAST(1000000 AS DOUBLE) AS retention_time,
 CAST(1 + event_id % 2 AS INT) AS ms_level, CAST(event_id % 3 - 1 AS INT) AS polarity,
 CASE WHEN event_id % 2 = 1 THEN CAST(300 + user_id AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS precursor_mz,
 CAST(CASE WHEN event_id % 2 = 1 THEN 2 ELSE 0 END AS INT) AS precursor_charge, value AS base_peak_intensity,
 CAST(event_id % 17 + 1 AS BIGINT) AS length, user_id, props FROM events"""

VIEWS: dict[str, str] = {
    "spectrum_index": _INDEX,
    "reads": """SELECT 'run' || CAST(o_orderkey % 4 AS STRING) AS run_name, o_orderkey AS read_index, 'r' || CAST(o_custkey AS STRING) AS read_name,
 'chr' || CAST(o_custkey % 3 + 1 AS STRING) AS chromosome, o_orderkey * 37 % 10000 AS position, CAST(o_orderkey % 61 AS INT) AS mapping_quality, o_orderkey % 4096 AS flags,
 CASE WHEN o_orderkey % 11 = 0 THEN '*' WHEN o_orderkey % 13 = 0 THEN '5Q3M' ELSE CAST(50 + o_orderkey % 50 AS STRING) || 'M' || CAST(1 + o_orderkey % 7 AS STRING) || 'D' || CAST(1 + o_orderkey % 5 AS STRING) || 'S' || CAST(2 + o_orderkey % 9 AS STRING) || '=' END AS cigar,
 CASE WHEN o_orderkey % 5 = 0 THEN '=' WHEN o_orderkey % 7 = 0 THEN '*' ELSE 'chr' || CAST(o_orderkey % 3 + 1 AS STRING) END AS mate_chromosome,
 o_orderkey % 100 - 1 AS mate_position, CAST(o_custkey % 400 AS INT) AS template_length FROM orders""",
    "identifications": """SELECT 'run' || CAST(l_suppkey % 3 AS STRING) AS run_name, l_orderkey % 500 AS spectrum_index, p_name AS chemical_entity, 1 - l_discount AS confidence_score
 FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "subjects": "SELECT c_custkey AS subject_id, c_name AS external_id, c_mktsegment AS project, CAST(1930 + c_custkey % 80 AS INT) AS birth_year, c_acctbal AS score FROM customer",
    "samples": "SELECT o_orderkey AS sample_id, o_custkey AS subject_id, o_orderkey % 100 AS container_id, o_orderpriority AS tissue, o_totalprice AS mass FROM orders",
    "containers": "SELECT s_suppkey AS container_id, s_name AS uri, n_name AS project, s_acctbal AS size FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "phenotypes": "SELECT o_custkey AS subject_id, l_returnflag AS name, l_quantity AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "units": """SELECT event_id % 4 AS dataset_id, event_id AS au_sequence, CAST(CASE WHEN event_id % 4 = 3 THEN 5 ELSE event_id % 2 END AS INT) AS spectrum_class,
 ({us} - 1704067200000000) / CAST(1000000 AS DOUBLE) AS retention_time, CAST(1 + event_id % 2 AS INT) AS ms_level, CAST(event_id % 3 AS INT) AS polarity,
 CAST(300 + user_id AS DOUBLE) AS precursor_mz, CAST(event_id % 5 AS INT) AS precursor_charge, CASE WHEN event_id % 4 = 3 THEN 'chr' || CAST(user_id % 3 + 1 AS STRING) ELSE '' END AS chromosome,
 event_id * 37 % 10000 AS position FROM events""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table; raw tables are read through Parquet, so filters and columns reach the scan."""
    text = VIEWS[name].replace("{us}", "unix_micros(CAST(ts AS TIMESTAMP))")
    frames = {t: table(spark, sf_dir, t) for t in TABLES if f" {t}" in text}
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **frames)


def oracle(*names: str) -> str:
    """WITH clause of domain tables for DuckDB."""
    text = lambda n: VIEWS[n].replace("{us}", "epoch_us(ts)").replace("AS STRING", "AS VARCHAR").replace("AS INT)", "AS INTEGER)")
    return "WITH " + ", ".join(f"{n} AS ({text(n)})" for n in names) + " "
