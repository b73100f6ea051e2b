"""The training-data pipeline: toxicity, exact dedup, near-duplicate join, source mixing, encoding.

Each stage is ``(name, function(spark, docs, sf_dir) -> DataFrame)``; its result
is written as Parquet and read again as the next stage's documents.  All but the
last return the columns of the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from insight.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from insight.llm.base import DOCUMENT, documents, importable, landed


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on labelled ones among them, rejects go."""
    importable(spark)
    return toxicity.clean(docs, toxicity.train_split(spark, docs, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts stays: that with the largest doc_id."""
    importable(spark)
    return exact_dedup.deduplicate(docs, exact_dedup.new_index(spark)).select(DOCUMENT)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity links join stays: that with the smallest doc_id."""
    importable(spark)
    return ngram_join.deduplicate(docs).select(DOCUMENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them, dealt to shards and shuffled there."""
    importable(spark)
    return mixing.mix(docs, int(spark.conf.get("spark.sql.shuffle.partitions"))).select(DOCUMENT)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of each row of the mix."""
    importable(spark)
    return bpe.round_trip(docs, bpe.vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("source_mixing", mixing_stage),
    ("bpe_round_trip", encoding_stage),
]

#: the toxicity model is fitted and has no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; the last one's rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
