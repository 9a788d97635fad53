"""The corpus pipeline: five stages over `documents`, each a function of (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkquarry.llm import stages
from sparkquarry.llm.storage import as_written, release

STAGES = [
    ("quality_classifier", stages.quality_filter),
    ("toxicity", stages.toxicity_filter),
    ("exact_dedup", stages.exact_dedup),
    ("minhash_dedup", stages.minhash_dedup),
    ("best_fit_packing", stages.best_fit_packing),
]

#: The classifiers are fitted by gradient steps, which SQL can't state; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each reads what the one before it wrote, which goes when the next has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, as_written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(last)
    return STAGES[-1][1](spark, docs, sf_dir)
