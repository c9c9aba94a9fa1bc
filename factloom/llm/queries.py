"""The ten operators as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, exact_dedup, langid, ngram_jaccard, packing, sentencepiece_codec, sharding, substring_dedup, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": ngram_jaccard.query,
        "op2_exact_dedup": exact_dedup.query,
        "op3_substring_dedup": substring_dedup.query,
        "op4_toxicity": toxicity.query,
        "op5_sharding": sharding.query,
        "op6_suffix_dedup": suffix_dedup.query,
        "op7_language_id": langid.query,
        "op8_embedding_dedup": embedding_dedup.query,
        "op9_packing": packing.query,
        "op10_sentencepiece": sentencepiece_codec.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": ngram_jaccard.SQL, "op2_exact_dedup": exact_dedup.SQL, "op8_embedding_dedup": embedding_dedup.SQL}
