"""Queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscale.llm import alignment, embeddings, importance, language_model, licenses, mixing, packing, quality, sharding, simhash, substrings, token_files, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_extendible_shards": sharding.op1_extendible_shards,
    "op2_temperature_mix": mixing.op2_temperature_mix,
    "op3_pruned_graph": embeddings.op3_pruned_graph,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_robust_quality": quality.op5_robust_quality,
    "op6_license_digests": licenses.op6_license_digests,
    "op7_trie_language_model": language_model.op7_trie_language_model,
    "op8_simhash_groups": simhash.op8_simhash_groups,
    "op9_sum_of_squares": packing.op9_sum_of_squares,
    "op10_token_binary": token_files.op10_token_binary,
    "op11_fm_substrings": substrings.op11_fm_substrings,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_token_alignment": alignment.op13_token_alignment,
}
ORACLES: dict[str, str] = {
    "op1_extendible_shards": sharding.OP1_SQL,
    "op2_temperature_mix": mixing.OP2_SQL,
    "op6_license_digests": licenses.OP6_SQL,
}
