"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sparkquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that Python workers get at a time where `batch` is given, and of a table's row groups: what a task holds doesn't follow the files it reads.
SENT = 8 << 20
ROW_GROUP = 32 << 20
#: Shuffle files go when an action ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, held: dict[str, str]) -> Iterator[None]:
    """Settings that hold for a while."""
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, batch: int = 0) -> DataFrame:
    """The same rows read back from a table: later steps neither recompute them nor need the executors that made them.

    batch: rows that Python workers get at a time while the table is made, where rows are large; and SENT bytes, about.
    What was shuffled to make the table is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, {CLEANUP: "true"} | ({BATCH: str(batch), BATCH_BYTES: str(SENT)} if batch else {})):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def as_written(df: DataFrame, name: str) -> DataFrame:
    """df itself if written() made it, else its rows read back."""
    return df if hasattr(df, "_table_path") else written(df, name)


def release(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_table_path", None)
        if path:
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


#: A key is hot if it holds this share of the rows or more; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, unique: str) -> DataFrame:
    """Left join with a right side that has one row a key and in `weight` the number of left rows of that key.

    Hot keys (at most 1 / HOT_SHARE of them) are broadcast; their left rows don't meet in one task.
    `unique` is a left column that spreads those rows over the tasks of the other join.
    """
    least = max(1000, int(total * HOT_SHARE))
    values = [c for c in right.columns if c != key]
    packed = F.struct(*values)
    hot = right.where(F.col(weight) >= least).select(F.col(key).alias("_k"), packed.alias("_hot"))
    cold = right.where(F.col(weight) < least).select(F.col(key).cast("string").alias("_c"), packed.alias("_cold"))
    out = left.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    out = out.withColumn("_q", F.when(F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("#"), F.col(unique).cast("string"))))
    out = out.join(cold, F.col("_q") == F.col("_c"), "left").drop("_q", "_c")
    out = out.withColumn("_v", F.coalesce("_hot", "_cold")).drop("_hot", "_cold")
    return out.select(*left.columns, *[F.col(f"_v.{c}").alias(c) for c in values])


#: Size of a bitmap of classes; 2 ** 26 bits are 8 MB for any input.
BITS = 1 << 26


def bitmap(bits: DataFrame, size: int = BITS) -> np.ndarray:
    """Bytes with the bits that a column `bit` of numbers below size names. At most size / 8 bytes reach the driver."""
    number = F.col("bit") + 1  # these functions count from 1
    with settings(bits.sparkSession, {CLEANUP: "true"}):
        packed = bits.groupBy(F.bitmap_bucket_number(number).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for row in packed:
        at = (row["part"] - 1) * 4096
        block = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[at : at + len(block)] = block[: len(out) - at]
    return out


class Packed:
    """Pickles a bitmap packed, as the bitmap itself: each executor writes what is broadcast to its disk, and few rows leave most bytes 0."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __reduce__(self) -> tuple:
        return _unpacked, (zlib.compress(self.bits, 1),)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)
