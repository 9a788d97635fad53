"""Held-out folds and the bounded samples of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; null keys count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled documents outside the held-out fold, the first in an order by hash.

    The ids of the sample are broadcast: `rows` bounds them. A document with several labels takes the largest.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), parts) != held_out))
    ids = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return docs.join(F.broadcast(ids), docs["doc_id"] == ids["_id"]).select(F.coalesce(docs["text"], F.lit("")).alias("text"), "label")
