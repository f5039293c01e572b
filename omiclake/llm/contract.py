"""Columns of the operators' queries that SQL can give too, each with that SQL; every row comes from its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omiclake.llm import cws
from omiclake.llm.bpe import op5_byte_level_bpe
from omiclake.llm.common import documents
from omiclake.llm.hashtree import op8_hash_tree_sharding
from omiclake.llm.lm import op1_context_mixing_score
from omiclake.llm.mixing import op9_mix_sources
from omiclake.llm.rules import op6_quality_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: A whole text; its words; crc32 of doc_id's text, bit by bit.
TEXT = "coalesce(text, '')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = f"translate({TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BITS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda k: (unicode(ch) >> k) & 1)))"
CRC = f"CASE WHEN doc_id IS NULL THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, {BITS}), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) END"


def contract(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@contract(f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {CRC} % 10 = 0 AS held_out, list_append({WORDS.format(LOWER)}, '') AS toks FROM documents),
 t AS (SELECT r, doc_id, held_out, unnest(toks) AS w FROM d),
 c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
 s AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
 SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, max(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 3) AS base_score
 FROM t LEFT JOIN c USING (w) CROSS JOIN s GROUP BY r, doc_id, held_out""")
def lm_base_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and the base of operator 1; log10 to three decimals."""
    return op1_context_mixing_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


@contract(f"""WITH d AS (SELECT doc_id, {TEXT} AS t, coalesce(lead({TEXT}) OVER (ORDER BY doc_id), first_value({TEXT}) OVER (ORDER BY doc_id)) AS nx FROM documents)
 SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(nx, length(t) // 2)) AS edited_sha256 FROM d""")
def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts of operator 4, by its own step; no fingerprints are drawn for them."""
    return cws.edits(cws.edited_rows(documents(spark, sf_dir)))


@contract(f"SELECT doc_id, sha256({TEXT}) AS decoded_sha256 FROM documents")
def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 5 decodes its ids to: the text itself."""
    return op5_byte_level_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


@contract(rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TEXT} AS t, {WORDS.format(TEXT)} AS w FROM documents),
 win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
 again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
 cov AS (SELECT r, count(DISTINCT p) AS k FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
 n AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(k, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (r))
 SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n""")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted rules of operator 6."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@contract(f"SELECT doc_id, CAST(strlen({TEXT}) + 16 AS BIGINT) AS size, 'key' AS law FROM documents")
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of operator 8."""
    return op8_hash_tree_sharding(spark, sf_dir).select("doc_id", "size", "law")


@contract(f"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS.format(TEXT)}) AS BIGINT) AS size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source),
 w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
 o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * z / w, source NULLS LAST) AS k FROM w),
 p AS (SELECT a.k, CAST(min(a.t) - coalesce(sum(3 * b.z), 0) AS DOUBLE) / (min(a.v) - coalesce(sum(b.w), 0)) AS level FROM (SELECT *, sum(z) OVER () AS t, sum(w) OVER () AS v FROM o) a LEFT JOIN o b ON b.k < a.k GROUP BY a.k),
 l AS (SELECT level FROM p JOIN o USING (k) WHERE 3 * z >= level * w OR k = (SELECT max(k) FROM o) ORDER BY k LIMIT 1)
 SELECT doc_id, size, z AS source_size, round(least(3.0::DOUBLE * z, level * w), 3) AS target FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source CROSS JOIN l""")
def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of operator 9, to three decimals: a source's weight times the one level at which capped targets sum to all."""
    return op9_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))
