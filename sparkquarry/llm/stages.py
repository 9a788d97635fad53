"""Stages of the corpus pipeline. All but the last return the columns of their input.

A key names one document: rows that repeat it share one decision. Null keys are a key of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, minhash, packing, quality, toxicity
from .storage import BITS, bitmap, written

CAPACITIES = [512, 1024, 2048, 4096, 8192]
#: Whole texts that a classifier's Python worker gets at a time. Both classifiers write what they keep, since only the action that runs a plan sets this.
TEXTS = 1000


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What classifiers are fitted on: the labelled documents as they came, whatever an earlier stage has dropped."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the keys (_id)."""
    return bitmap(keys.select(F.pmod(F.xxhash64("_id"), F.lit(BITS)).alias("bit")))


def _within(docs: DataFrame, bitmaps: list[np.ndarray]) -> Column:
    """In how many of the bitmaps, from the first on, a row's doc_id may be; so no row is shuffled to find out."""
    bit = F.pmod(F.xxhash64(docs["doc_id"]), F.lit(BITS))
    return exact._among(docs.sparkSession, bitmaps, *[bit] * len(bitmaps))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality."""
    machine = quality.learned(_documents(spark, sf_dir), _labels(spark, sf_dir), "quality", 3, 1)
    return written(docs.where(quality.predicted(machine, docs)("text") == 1), "good", TEXTS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    lexicon = toxicity.learned(_documents(spark, sf_dir), _labels(spark, sf_dir), "toxic", 5, 0)
    return written(docs.where(toxicity.predicted(lexicon)("text") == 0), "clean", TEXTS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of all documents with the same text, A-Z in either case; the one with the largest key.

    Only rows of groups that may stay are shuffled. A name that docs can't have marks them.
    """
    found = written(exact.exact_duplicates(docs).where("group_size > 1").select(F.col("doc_id").alias("_id"), "kept", F.col("digest").alias("_digest")), "groups")
    kept = written(found.where("kept").select("_id", "_digest").distinct(), "kept")
    within = _within(docs, [_bits(found), _bits(kept)])
    mark = _fresh(docs)
    marked = docs.withColumn(mark, F.sha2(exact.normalised(F.coalesce(docs["text"], F.lit(""))), 256))
    # In a group: the row that stays, once. A key whose bit merely equals a group's has no group.
    maybe = marked.where(within == 2)
    stays = maybe.join(kept, maybe["doc_id"].eqNullSafe(kept["_id"]) & (maybe[mark] == kept["_digest"]), "left_semi").dropDuplicates(["doc_id", mark])
    others = marked.where(within > 0)
    digests = found.select("_digest").distinct()
    return docs.where(within == 0).unionByName(stays.drop(mark)).unionByName(others.join(digests, others[mark] == digests["_digest"], "left_anti").drop(mark))


def _fresh(docs: DataFrame) -> str:
    name = "_mark"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest key. Only rows that may go are shuffled."""
    gone = written(minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    within = _within(docs, [_bits(gone)])
    maybe = docs.where(within == 1)
    return docs.where(within == 0).unionByName(maybe.join(gone, maybe["doc_id"].eqNullSafe(gone["_id"]), "left_anti"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a bin for every document; the length is its number of words and one."""
    return packing.packed(packing.words(docs.select("doc_id", "text")), "n_words", CAPACITIES)
