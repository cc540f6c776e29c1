"""The corpus pipeline: five stages, each an operator of allelemill.llm, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from allelemill.llm import exact_dedup, jaccard_join, mixing, packing, queries, toxicity_crf
from allelemill.llm.common import labels, shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field, fitted on the labels of docs, scores below the limit."""
    train = labels(spark, sf_dir)
    model = toxicity_crf.fitted(docs, train, train["doc_id"].isNotNull())
    return toxicity_crf.kept(docs, model, queries.LIMIT)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts, that with the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.packed(docs, queries.tokenizer_path())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("jaccard_join", near), ("mixing", mix), ("packing", pack)]

#: The stages learn models and solve linear programs, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
