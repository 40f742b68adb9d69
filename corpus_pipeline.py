"""A corpus pipeline of five operators, each over all that the one before it kept.

1. ``toxicity``: documents that the classifier rejects (by their language's calibrated threshold) go.
2. ``near_duplicates``: one document of each group of near copies stays (five words, similarity 0.8).
3. ``decontamination``: documents that hold a benchmark item go.
4. ``personal_data``: spans are replaced by their kind.
5. ``packing``: what is left is encoded and packed; one row per piece.

Stages 1 to 4 return the columns of ``documents``.  ``run`` writes each stage's
result to the shared store and reads it again.  ``ORACLE_SQL`` is None: trained
classifiers and the tokenizer cannot be expressed in SQL; ``tests/llm`` holds
every stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featurescope.llm import decontamination, jaccard, packing, pii, toxicity
from featurescope.runtime import materialise


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, column="toxicity_score_")
    return scored.where(~toxicity.is_toxic(model, "toxicity_score_")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.learn(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
