"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folder below the shared one that tables of the running work go to, so that they can be deleted together.
_WORK: ContextVar[str] = ContextVar("work", default="")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset and the session is local, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sparkquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def work(name: str) -> Iterator[None]:
    """Tables that are written in here go to a folder of their own, which dropped() deletes."""
    token = _WORK.set(f"/{name}")
    try:
        yield
    finally:
        _WORK.reset(token)


def _path(spark: SparkSession, name: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def dropped(spark: SparkSession, name: str) -> None:
    """Delete the tables of work(name)."""
    fs, where = _path(spark, name)
    fs.delete(where, True)


def left(spark: SparkSession, name: str) -> bool:
    """Whether tables of work(name) are there."""
    fs, where = _path(spark, name)
    return fs.exists(where)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table: later steps neither recompute them nor need the executors that made them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}{_WORK.get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
