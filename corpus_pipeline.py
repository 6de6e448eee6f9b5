"""The corpus pipeline: from raw documents to training shards.

``STAGES`` are applied in order, each to all that its predecessor kept; what a stage
returns is written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorfill.llm.common import stored
from sensorfill.llm.decontaminate import drop_contaminated
from sensorfill.llm.mixing import mix
from sensorfill.llm.shards import training_shards
from sensorfill.llm.simhash import drop_near_copies
from sensorfill.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores 0.5 or more go."""
    return drop_toxic(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    return drop_contaminated(spark, docs, sf_dir)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are sampled and repeated to their target weights, in training order."""
    return mix(docs)


def output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as fixed-stride training shards."""
    return training_shards(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("output", output),
]

# Hashes of token ids and learned scores have no SQL; tests/llm has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
