"""The corpus pipeline: documents in, packed training sequences out. Each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, langid, ngram_jaccard, packing, substring_dedup
from factloom.llm.common import materialize

#: (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("language_id", langid.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", ngram_jaccard.stage),
    ("substring_dedup", substring_dedup.stage),
    ("packing", packing.stage),
]

#: A trained network decides in the first stage, which SQL cannot express; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
