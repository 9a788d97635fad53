"""Exact deduplication by progressive refinement: length, then a hash of the first bytes, then a hash of all bytes.

Each step counts small rows and leaves a bitmap of the classes that still have two rows or more. The next step
reads on only for rows whose class is in the bitmap: the first looks at lengths, the second at PREFIX characters of those
that share one, the third at the whole text of those that share both. Bitmaps follow the number of rows up to MOST bits;
two classes that share a bit are merely read further than need be, so results never depend on them. No text is shuffled
or leaves the JVM: Python sees lengths and hashes only. The pass of the third step makes the prefix hash of every row again,
so that one look at both bitmaps tells whose whole text to read.

Texts are equal when identical after lower-casing A-Z. Null counts as empty, and empty texts equal each other. The
row with the largest key stays; null keys are smaller than all others. Rows that repeat a key and a text are copies
like any other, and all of them carry kept = true if their key is the one that stays (a key names one document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import BITS, Packed, bitmap, lookup, written

#: Characters of a text that the second step hashes, and bits of a bitmap at most.
PREFIX = 256
MOST = 1 << 29
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else touched."""
    return F.translate(text, UPPER, LOWER)


def _shared(classes: DataFrame, bits: int) -> np.ndarray:
    """Bits of the classes (column `class`) that have two rows or more."""
    return bitmap(classes.groupBy(F.pmod("class", F.lit(bits)).alias("bit")).count().where("count > 1"), bits)


def _among(spark, bitmaps: list[np.ndarray], *numbers: Column) -> Column:
    """How many of the bitmaps, from the first on, have the bit of their number set. One Python worker a task looks at all of them."""
    sent = spark.sparkContext.broadcast([Packed(bits) for bits in bitmaps])

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = (columns,) if isinstance(columns, pd.Series) else columns
            on, out = np.ones(len(columns[0]), bool), np.zeros(len(columns[0]), np.int32)
            for x, bits in zip(columns, sent.value, strict=True):
                at = x.to_numpy(np.int64) % (len(bits) * 8)
                on &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                out += on
            yield pd.Series(out)

    return F.pandas_udf(run, "int")(*numbers)


def refined(docs: DataFrame, key: str = "doc_id", text: str = "text", all_digests: bool = False) -> DataFrame:
    """(key, alone, digest) of each row: SHA-256 of the normalised text where another row may equal it, else null.

    With all_digests every row has its digest; `alone` still says where refinement ended before the last step.
    """
    spark = docs.sparkSession
    bits = min(MOST, max(BITS >> 6, 1 << (16 * docs.count()).bit_length()))
    rows = docs.select(docs[key].alias(key), F.coalesce(docs[text], F.lit("")).alias("_t"))
    rows = rows.withColumn("_len", F.octet_length("_t").cast("long"))
    lengths = _shared(rows.select(F.col("_len").alias("class")), bits)
    prefix = F.xxhash64("_len", normalised(F.substring("_t", 1, PREFIX)))
    both = _shared(rows.where(_among(spark, [lengths], F.col("_len")) == 1).select(prefix.alias("class")), bits)
    rows = rows.withColumn("alone", _among(spark, [lengths, both], F.col("_len"), prefix) < 2)
    digest = F.sha2(normalised(F.col("_t")), 256)
    return rows.select(key, "alone", (digest if all_digests else F.when(~F.col("alone"), digest)).alias("digest"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", all_digests: bool = False) -> DataFrame:
    """(key, keep_id, group_size, kept, digest) of each row."""
    rows = written(refined(docs, key, text, all_digests), "digests")
    groups = rows.where("not alone").groupBy("digest").agg(F.max(key).alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    group_key = F.when(~F.col("alone"), F.col("digest"))
    spread = F.coalesce(F.col(key).cast("string"), F.lit("-"))
    left = rows.withColumn("_g", F.coalesce(group_key, F.concat(F.lit("="), spread))).withColumn("_u", F.concat(spread, F.lit(":"), F.coalesce("digest", F.lit(""))))
    out = lookup(left, groups.select(F.col("digest").alias("_g"), "keep_id", "group_size"), "_g", "group_size", rows.count(), "_u")
    own = F.col("group_size").isNull()
    keep = F.when(own, F.col(key)).otherwise(F.col("keep_id"))
    return out.select(key, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col(key).eqNullSafe(keep).alias("kept"), "digest")
