"""Scans that run beside their caller, and the state of a watch over batches."""

from __future__ import annotations

import time

import pytest

from sparkquarry import tables
from sparkquarry.plans import analysis, running
from sparkquarry.sources import files
from sparkquarry.streaming import watch

UNIT = "unit u;\ninterface\nimplementation\nprocedure P;\nbegin\n  goto x;\nend;\nend.\n"


def test_a_scan_that_is_left_alone(spark):
    scan = running.Running(files.in_memory(spark, {"u.pas": UNIT}), analysis.Settings(profile="security"))
    assert scan.result(300).count() == 0
    jobs, done, every = scan.progress()
    assert jobs > 3 and 0 < done <= every
    assert not tables.left(spark, scan.tag) and tables.left(spark, f"{scan.tag}-found")
    scan.drop()
    assert not tables.left(spark, f"{scan.tag}-found")


def test_a_scan_is_ended_while_a_job_runs(spark):
    from pyspark.sql import functions as F

    slow = F.udf(lambda data: time.sleep(60) or data, "binary")
    source = files.in_memory(spark, {"u.pas": UNIT}).withColumn("content", slow("content"))
    scan = running.Running(source, analysis.Settings(profile="security"))
    tracker = spark.sparkContext.statusTracker()
    until = time.time() + 60
    while not (tracker.getJobIdsForGroup(scan.tag) and tracker.getActiveJobsIds()) and time.time() < until:
        time.sleep(0.1)
    time.sleep(1)
    began = time.time()
    assert scan.cancel()
    assert time.time() - began < 15
    with pytest.raises(analysis.Cancelled):
        scan.result()
    assert not tables.left(spark, scan.tag) and not tables.left(spark, f"{scan.tag}-found")


def test_tables_of_work_go_together(spark):
    with tables.work("some-work"):
        kept = tables.written(spark.range(3), "t")
        assert kept.count() == 3 and tables.left(spark, "some-work")
    tables.dropped(spark, "some-work")
    assert not tables.left(spark, "some-work")


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(watch.STORE)
    spark.conf.set(watch.STORE, watch.ROCKS)
    yield
    spark.conf.set(watch.STORE, before)


def versions(spark, folder, batch: int, rows: list[tuple[str, str, str]]) -> None:
    """Rows (file, time, text) of one batch."""
    out = spark.createDataFrame([(f, t, len(x), x.encode()) for f, t, x in rows], "file_id string, t string, length long, content binary")
    out.selectExpr("file_id", "cast(t as timestamp) as modificationTime", "length", "content").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_an_older_version_that_comes_later_is_dropped(spark, tmp_path, rocks):
    got: list[tuple] = []
    batches = [
        [("a.pas", "2024-01-01 10:00:00", "a1"), ("b.pas", "2024-01-01 10:00:00", "b1")],
        [("a.pas", "2024-01-01 09:00:00", "older"), ("b.pas", "2024-01-01 10:00:05", "b2")],
        # a late burst: three versions at once, the newest in the middle
        [("a.pas", "2024-01-01 10:00:01", "a2"), ("a.pas", "2024-01-01 10:00:09", "a4"), ("a.pas", "2024-01-01 10:00:02", "a3"), ("b.pas", "2024-01-01 10:00:05", "same")],
    ]
    versions(spark, tmp_path, 0, batches[0])
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    for i, rows in enumerate(batches):
        if i:
            versions(spark, tmp_path, i, rows)
        stream = watch.newest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend((i, r["file_id"], bytes(r["content"]).decode(), r["generation"]) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    assert sorted(got) == [(0, "a.pas", "a1", 1), (0, "b.pas", "b1", 1), (1, "b.pas", "b2", 2), (2, "a.pas", "a4", 2)]


class Held:
    """A value state, and timers, as the processor sees them."""

    def __init__(self):
        self.value, self.timers = None, set()

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getValueState(self, name, schema, **ttl):
        return Held()

    def registerTimer(self, due):
        self.timers.add(due)

    def deleteTimer(self, due):
        self.timers.remove(due)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_a_version_waits_until_it_is_quiet():
    """Versions that come while one waits take its place; the last one is told when its timer ends, a stale one never."""
    import pandas as pd

    handle, processor = Held(), watch.Newest(quiet_ms=100)
    processor.init(handle)
    rows = lambda t, x: iter([pd.DataFrame({"modificationTime": [pd.Timestamp(t)], "length": [len(x)], "content": [x.encode()]})])
    assert list(processor.handleInputRows(("a.pas",), rows("2024-01-01 10:00:00", "a1"), Clock(1000))) == [] and handle.timers == {1100}
    assert list(processor.handleInputRows(("a.pas",), rows("2024-01-01 10:00:01", "a2"), Clock(1050))) == [] and handle.timers == {1150}
    assert list(processor.handleInputRows(("a.pas",), rows("2024-01-01 09:00:00", "old"), Clock(1060))) == [] and handle.timers == {1150}
    told = list(processor.handleExpiredTimer(("a.pas",), Clock(1150), None))
    assert [(r.file_id, r.content, r.generation) for pdf in told for r in pdf.itertuples()] == [("a.pas", b"a2", 2)]
    assert list(processor.handleExpiredTimer(("a.pas",), Clock(1150), None)) == []
