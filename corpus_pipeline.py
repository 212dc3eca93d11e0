"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir), where docs are all rows its predecessor kept, and returns
a DataFrame that is written as Parquet and read again as the next stage's docs. All but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sunledger.llm.jaccard_join import keep_one_of_each
from sunledger.llm.mixing import mix_corpus
from sunledger.llm.packing import pack_documents
from sunledger.llm.scratch import Scratch
from sunledger.llm.substring_dedup import cut_repeats
from sunledger.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go."""
    return drop_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard similarity of 5-word shingles >= 0.8 one document stays."""
    return keep_one_of_each(spark, docs, n=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur again anywhere are cut out."""
    return cut_repeats(spark, docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are copied or left out so that sources meet their target weights."""
    return mix_corpus(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, each with its sequence and offset."""
    return pack_documents(spark, docs)


STAGES = [
    ("toxicity", toxicity),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]
#: A trained classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written before the next begins."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
            scratch.drop_but(name)
            scratch.release()
    return docs
