"""Corpus pipeline: toxicity filter, near-duplicate removal, secret redaction, sequence packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantjobs.llm.common import load, saved
from quantjobs.llm.stages import deduplicated, packed, redacted, without_toxic

#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [("toxicity", without_toxic), ("near_dedup", deduplicated), ("secret_scan", redacted), ("best_fit_packing", packed)]

#: Viterbi decoding, minhashing, regular-expression spans and a genetic search are not SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the whole documents table; each result is written and read again."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
