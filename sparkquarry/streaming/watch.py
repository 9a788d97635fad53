"""Watching a folder: units are scanned again when they are saved."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sparkquarry.plans import analysis
from sparkquarry.sources import sinks

FILES = "path string, modificationTime timestamp, length long, content binary"
VERSIONS = "file_id string, modificationTime timestamp, length long, content binary, generation long"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def saved(spark: SparkSession, path: str, pattern: str = "*.{pas,dfm}") -> DataFrame:
    """A stream of (file_id, modificationTime, length, content) of files as they appear."""
    read = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return read.withColumnRenamed("path", "file_id")


class Newest(StatefulProcessor):
    """Keeps the newest version of each file over all batches, with the number of versions that were newer than all before (its generation).

    A version that isn't newer than the one kept is stale and is dropped, however late it comes. With quiet_ms a new version
    waits for that long and is told when its timer ends; one that comes meanwhile takes its place and the timer begins
    anew. What a file's state holds expires after keep_ms without a version, if that is set.
    """

    def __init__(self, quiet_ms: int = 0, keep_ms: int = 0) -> None:
        self.quiet_ms, self.keep_ms = quiet_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = {"ttlDurationMs": self.keep_ms} if self.keep_ms else {}
        self.newest = handle.getValueState("newest", "at long, generation long", **ttl)
        self.waiting = handle.getValueState("waiting", "at timestamp, length long, content binary, due long", **ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:
            last = pdf.iloc[pdf["modificationTime"].to_numpy().argmax()]
            if best is None or last["modificationTime"] > best["modificationTime"]:
                best = last
        at = int(best["modificationTime"].value)
        known = self.newest.get() if self.newest.exists() else (-(1 << 62), 0)
        if at <= known[0]:
            return
        self.newest.update((at, known[1] + 1))
        if not self.quiet_ms:
            yield self._told(key, best["modificationTime"], best["length"], best["content"], known[1] + 1)
            return
        if self.waiting.exists():
            self.handle.deleteTimer(self.waiting.get()[3])
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.waiting.update((best["modificationTime"].to_pydatetime(), int(best["length"]), bytes(best["content"]), due))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            at, length, content, _ = self.waiting.get()
            generation = self.newest.get()[1] if self.newest.exists() else 1
            self.waiting.clear()
            yield self._told(key, at, length, content, generation)

    @staticmethod
    def _told(key, at, length, content, generation) -> pd.DataFrame:
        return pd.DataFrame({"file_id": [key[0]], "modificationTime": [pd.Timestamp(at)], "length": [int(length)], "content": [bytes(content)], "generation": [int(generation)]})

    def close(self) -> None:
        pass


def newest(rows: DataFrame, quiet_ms: int = 0, keep_ms: int = 0) -> DataFrame:
    """A stream of VERSIONS of a stream of (file_id, modificationTime, length, content): each file's versions that are newer than all before.

    With timers or expiry batches go on without new rows, so such a stream never ends by itself.
    """
    time = "ProcessingTime" if quiet_ms or keep_ms else "None"
    return rows.select("file_id", "modificationTime", "length", "content").groupBy("file_id").transformWithStateInPandas(statefulProcessor=Newest(quiet_ms, keep_ms), outputStructType=VERSIONS, outputMode="Update", timeMode=time)


def accepted(arrivals: DataFrame, key: str, arrival: str, version: str) -> DataFrame:
    """The arrivals that newest() would let through one by one, for a table: those with a version above all that came before, with their generation."""
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    highest = F.max(version).over(before)
    fresh = (F.col(version).isNotNull() & (highest.isNull() | (F.col(version) > highest))).cast("int")
    return arrivals.withColumn("_fresh", fresh).withColumn("generation", F.sum("_fresh").over(so_far)).where("_fresh = 1").drop("_fresh")


def watch(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], settings: analysis.Settings = analysis.Settings(profile="ide-fast"), every: str = "300 milliseconds", once: bool = False, quiet_ms: int = 0) -> StreamingQuery:
    """Scan what was saved since the last trigger and hand its findings to sink(findings, batch). Stale versions are left out.

    The state of files lies in RocksDB; the session's setting is changed only while the query starts. A trigger that runs once
    can't wait for timers, so quiet_ms belongs to a watch that goes on.
    """
    if once and quiet_ms:
        raise ValueError("a watch that runs once can't wait for quiet")

    def batch(rows: DataFrame, number: int) -> None:
        sink(analysis.scan(rows.select("file_id", "content", "length"), settings), number)

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        writer = newest(saved(spark, path), quiet_ms).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
    finally:
        spark.conf.set(STORE, before)


def publish(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for watch(): the diagnostics of each generation as JSON lines in a folder of its own, once however often it is tried."""

    def sink(found: DataFrame, generation: int) -> None:
        sinks.diagnostics(found).select("value").write.mode("overwrite").text(f"{path}/generation={generation}")

    return sink


def bursts(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): edits closer together than gap are one burst; works on streams, where `late` bounds the state."""
    window = F.session_window(F.col(ts), gap)
    grouped = events.withWatermark(ts, late).groupBy(key, window.alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
