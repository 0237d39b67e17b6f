"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns what it keeps; the next one reads that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import jaccard, mixing, packing, quality, toxicity
from tilewright.session import stage

STAGES = [
    ("toxicity", toxicity.stage_function),
    ("quality classifier", quality.stage_function),
    ("n-gram Jaccard join", jaccard.stage_function),
    ("mixing sources to target weights", mixing.stage_function),
    ("best-fit packing", packing.stage_function),
]

#: SQL can't express the classifiers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
