"""A scan that runs beside its caller, tells how far it is, and can be ended while a job runs."""

from __future__ import annotations

import threading
import uuid
from dataclasses import replace

from pyspark import InheritableThread
from pyspark.sql import DataFrame

from sparkquarry import tables

from . import analysis


class Running:
    """A scan of files (file_id, content, length) that has begun.

    Its jobs carry a tag and a group of their own. Its tables lie in one folder, which goes when the scan has ended, however it
    does; the findings are written beside it, where drop() deletes them.
    """

    def __init__(self, source: DataFrame, settings: analysis.Settings = analysis.Settings()) -> None:
        self.spark = source.sparkSession
        self.tag = f"scan-{uuid.uuid4().hex}"
        self.stopped = threading.Event()
        self.found: DataFrame | None = None
        self.error: BaseException | None = None
        asked = settings.progress
        go_on = lambda done, every: not self.stopped.is_set() and (asked is None or asked(done, every) is not False)
        self.thread = InheritableThread(target=self._run, args=(source, replace(settings, progress=go_on)), daemon=True)
        self.thread.start()

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        if self.stopped.is_set():
            raise analysis.Cancelled
        return tables.written(df, name)

    def _run(self, source: DataFrame, settings: analysis.Settings) -> None:
        context = self.spark.sparkContext
        context.setJobGroup(self.tag, "scan", interruptOnCancel=True)
        context.addJobTag(self.tag)
        try:
            with tables.work(self.tag):
                found = analysis.scan(source, settings, self._keep)
            with tables.work(f"{self.tag}-found"):
                self.found = self._keep(found, "findings")
        except BaseException as e:
            self.error = analysis.Cancelled() if self.stopped.is_set() else e
            tables.dropped(self.spark, f"{self.tag}-found")
        finally:
            tables.dropped(self.spark, self.tag)

    def progress(self) -> tuple[int, int, int]:
        """(jobs that were begun, tasks done, tasks of the stages known so far), as Spark's status tracker tells them."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = tracker.getJobIdsForGroup(self.tag)
        stages = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        told = [x for s in stages if (x := tracker.getStageInfo(s))]
        return len(jobs), sum(x.numCompletedTasks for x in told), sum(x.numTasks for x in told)

    def cancel(self, wait: float = 30) -> bool:
        """End the scan: jobs that run are interrupted, further ones aren't begun, and its tables go. Whether it has ended within the seconds to wait."""
        self.stopped.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        self.thread.join(wait)
        return not self.thread.is_alive()

    def result(self, wait: float | None = None) -> DataFrame:
        """The findings; raises what ended the scan, if it didn't end well."""
        self.thread.join(wait)
        if self.error is not None:
            raise self.error
        if self.found is None:
            raise TimeoutError("the scan goes on")
        return self.found

    def drop(self) -> None:
        """Delete the findings."""
        tables.dropped(self.spark, f"{self.tag}-found")
