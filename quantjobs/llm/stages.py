"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantjobs.llm.common import load
from quantjobs.llm.near_dedup import near_duplicates
from quantjobs.llm.packing import pack_documents
from quantjobs.llm.secret_scan import redact
from quantjobs.llm.toxicity import score, train

#: Documents that score this much go.
TOXIC = 0.7


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the folder's labels, does not reject. Null and empty texts stay."""
    model = train(docs.select("doc_id", "text"), load(spark, sf_dir, "labels"))
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, name).where(f"`{name}` < {TOXIC}").drop(name)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each group linked at a similarity of 0.8 or more.

    Empty texts are linked with nothing and stay; of rows that repeat a doc_id all stay or all go.
    """
    gone = near_duplicates(docs, times=(100, 80)).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in the text and n_chars counted anew (left as it is for null texts)."""
    chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return redact(docs).withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return pack_documents(docs)
