"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from omiclake.llm import contract
from omiclake.llm.bpe import op5_byte_level_bpe
from omiclake.llm.cws import op4_weighted_fingerprints
from omiclake.llm.gbt import op3_quality_classifier
from omiclake.llm.hashtree import op8_hash_tree_sharding
from omiclake.llm.lm import op1_context_mixing_score
from omiclake.llm.mixing import op9_mix_sources
from omiclake.llm.passages import op10_suffix_array_dedup
from omiclake.llm.rules import op6_quality_rules
from omiclake.llm.simhash import op2_simhash_near_dedup
from omiclake.llm.tokenfile import op7_token_files

QUERIES = {
    f.__name__: f
    for f in (op1_context_mixing_score, op2_simhash_near_dedup, op3_quality_classifier, op4_weighted_fingerprints, op5_byte_level_bpe, op6_quality_rules, op7_token_files, op8_hash_tree_sharding, op9_mix_sources, op10_suffix_array_dedup)
}

#: Their columns that SQL can give.
COLUMN_QUERIES = contract.QUERIES

#: For the columns of contract only: hashes of shingles, trained models, token ids and byte ranges aren't for SQL.
ORACLE_SQL: dict[str, str] = dict(contract.ORACLE_SQL)
