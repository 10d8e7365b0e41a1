"""The corpus pipeline: stages from raw documents to tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenmart.llm.common import stage
from lumenmart.llm.stages import deduplicate, mix_sources, near_deduplicate, reject_toxic, tokenize

STAGES = [
    ("toxicity", reject_toxic), ("exact_dedup", deduplicate), ("ngram_jaccard_join", near_deduplicate),
    ("mixing", mix_sources), ("bpe", tokenize),
]

#: Trained scores, sampled blocks and merge tables have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; each stage reads what the one before wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, step) in enumerate(STAGES, 1):
        docs = step(spark, docs, sf_dir)
        docs = docs if place == len(STAGES) else stage(docs)
    return docs
