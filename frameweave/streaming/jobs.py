"""Jobs in steps with progress, pause, resume and recovery (T5).

What happened to a job is a table of events in a folder that the cluster shares,
written by appending; its state is the latest event.  A job checks between steps
whether it was asked to pause, and starts behind its last completed step.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EVENT = "job_id string, kind string, done int, total int, message string, at_us bigint"


class Jobs:
    """The jobs of a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _say(self, job_id: str, kind: str, done: int, total: int, message: str | None = None) -> None:
        self.spark.createDataFrame([(job_id, kind, done, total, message, time.time_ns() // 1000)], _EVENT).coalesce(1).write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(_EVENT).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], _EVENT)

    def state(self) -> DataFrame:
        """``job_id, status, done, total, message``: the latest of each job; a request to pause shows once it is followed."""
        last = self.events().where("kind != 'pause'").groupBy("job_id").agg(F.max(F.struct("at_us", "done", "kind", "total", "message")).alias("e"))
        return last.select("job_id", F.col("e.kind").alias("status"), "e.done", "e.total", "e.message")

    def pause(self, job_id: str) -> None:
        """Ask a running job to stop before its next step."""
        self._say(job_id, "pause", 0, 0)

    def recover(self) -> int:
        """At start-up: jobs still marked as running were interrupted; returns how many."""
        lost = self.state().where("status = 'running'").collect()  # one row for each job that was running
        for r in lost:
            self._say(r["job_id"], "interrupted", r["done"], r["total"])
        return len(lost)

    def run(self, job_id: str, steps: Sequence[Callable[[], None]]) -> str:
        """Run the steps that aren't done yet; the resulting status: completed, paused or failed (with the message, raised again)."""
        before = self.state().where(F.col("job_id") == job_id).first()
        done = before["done"] if before else 0
        began = time.time_ns() // 1000
        self._say(job_id, "running", done, len(steps))
        for step in steps[done:]:
            asked = self.events().where((F.col("job_id") == job_id) & (F.col("kind") == "pause") & (F.col("at_us") >= began))
            if not asked.isEmpty():
                self._say(job_id, "paused", done, len(steps))
                return "paused"
            try:
                step()
            except Exception as e:
                self._say(job_id, "failed", done, len(steps), str(e)[:500])
                raise
            done += 1
            self._say(job_id, "running", done, len(steps))
        self._say(job_id, "completed", done, len(steps))
        return "completed"
