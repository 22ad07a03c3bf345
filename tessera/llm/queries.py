"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import exact, language, packing, passages, quality, sharding, simhash, suffixes, tokenizing, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        suffixes.op1_suffix_array,
        toxicity.op2_nnpu_toxicity,
        passages.op3_compact_windows,
        language.op4_crf_language,
        exact.op5_chunk_recipes,
        tokenizing.op6_trie_bpe,
        simhash.op7_bit_sliced_simhash,
        sharding.op8_feistel_shards,
        packing.op9_complement_packing,
        quality.op10_repetition_rules,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op5_chunk_recipes": exact.ORACLE}
