"""Runs of an analysis: counters of rows in the pass that makes them, progress while jobs run, and a stop flag."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from lodestone.storage import scratch_removed_on_failure

#: phase, share of its tasks that are done, message.
ProgressCall = Callable[[str, float, str], None]


def observed(rows: DataFrame, counters: Mapping[str, Column], call: Callable[[dict[str, Any]], None] | None = None) -> tuple[DataFrame, Observation]:
    """rows, and an observation that has the counters (aggregates) once an action has run over them, without a scan of its own.

    call takes the counters as soon as they are there, in a thread of its own.
    """
    seen = Observation(f"counters-{uuid.uuid4().hex}")
    out = rows.observe(seen, *[c.alias(name) for name, c in counters.items()])
    if call is not None:
        threading.Thread(target=lambda: call(seen.get), daemon=True).start()
    return out, seen


def counted_if(condition: Column) -> Column:
    """Rows for which the condition holds; null counts as not."""
    return F.coalesce(F.count_if(condition), F.lit(0))


class Stopped(Exception):
    """The run was stopped before its end."""


class Run:
    """Work in a thread of its own that can be watched and stopped.

    Its jobs carry a tag. stop() interrupts them, those that start later too, until the work has ended; scratch tables of work
    that was stopped or failed are deleted. A run that was stopped raises Stopped from result(), whatever the work made of it.
    """

    def __init__(self, spark: SparkSession, work: Callable[[SparkSession], Any], on_progress: ProgressCall | None = None, phase: str = "analysis", every: float = 0.25):
        self.spark, self.tag, self.phase, self.every, self.on_progress = spark, f"run-{uuid.uuid4().hex}", phase, every, on_progress
        self._stop, self._value, self._error = threading.Event(), None, None
        self._scratch: list[str] = []
        self._thread = threading.Thread(target=inheritable_thread_target(spark)(self._work), args=(work,), daemon=True)
        self._thread.start()
        if on_progress is not None:
            threading.Thread(target=self._watch, daemon=True).start()

    def _work(self, work: Callable[[SparkSession], Any]) -> None:
        context = self.spark.sparkContext
        try:
            with scratch_removed_on_failure(self.spark) as self._scratch:
                context.addJobTag(self.tag)
                context.setInterruptOnCancel(True)
                try:
                    self._value = work(self.spark)
                finally:
                    context.removeJobTag(self.tag)
                if self._stop.is_set():
                    raise Stopped(self.phase)
        except BaseException as error:  # handed to result()
            self._error = error

    def _watch(self) -> None:
        tracker, done_before = self.spark.sparkContext.statusTracker(), -1.0
        stages: dict[int, tuple[int, int]] = {}
        while self._thread.is_alive():
            for info in (tracker.getStageInfo(i) for i in tracker.getActiveStageIds()):
                if info is not None:
                    stages[info.stageId] = (info.numTasks, info.numCompletedTasks)
            total, done = (sum(x[k] for x in stages.values()) for k in (0, 1))
            share = done / total if total else 0.0
            if share != done_before:
                done_before = share
                self.on_progress(self.phase, share, f"{done} of {total} tasks")
            self._thread.join(self.every)
        self.on_progress(self.phase, 1.0, "stopped" if self._stop.is_set() else "failed" if self._error else "done")

    @property
    def running(self) -> bool:
        return self._thread.is_alive()

    def stop(self) -> None:
        """Returns when the work has ended."""
        self._stop.set()
        while self._thread.is_alive():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._thread.join(0.2)

    def result(self, timeout: float | None = None) -> Any:
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError(self.phase)
        if self._stop.is_set():
            raise Stopped(self.phase) from self._error
        if self._error is not None:
            raise self._error
        return self._value
