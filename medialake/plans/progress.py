"""Counts of a running job, told while it runs."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Progress:
    """Context in which a job runs: ``tell`` gets the counts ``every`` so many seconds, and once at its end.

    Tasks add to accumulators when they end, so counts grow by tasks; a task
    that runs again counts again, so they are for display only.
    """

    def __init__(self, spark: SparkSession, tell: Callable[[dict], None], every: float = 1.0):
        self.tell, self.every, self.context = tell, every, spark.sparkContext
        self.files, self.errors, self.bytes = (self.context.accumulator(0) for _ in range(3))
        self.over = threading.Event()

    def counted(self, decoded: DataFrame) -> DataFrame:
        """``decoded`` (decode_error, size_bytes), whose rows are counted as they pass."""
        files, errors, size = self.files, self.errors, self.bytes
        names = decoded.columns
        at_error, at_size = names.index("decode_error"), names.index("size_bytes")

        def run(batches):
            for b in batches:
                files.add(b.num_rows)
                errors.add(b.num_rows - b.column(at_error).null_count)
                size.add(sum(x or 0 for x in b.column(at_size).to_pylist()))
                yield b

        return decoded.mapInArrow(run, decoded.schema)

    def counts(self) -> dict:
        minutes = max(time.monotonic() - self.began, 1e-9) / 60
        n, bad = self.files.value, self.errors.value
        tracker = self.context.statusTracker()
        stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
        return {"discovered": n, "processed": n - bad, "errors": bad, "bytes": self.bytes.value, "images_per_minute": (n - bad) / minutes, "tasks": sum(s.numTasks for s in stages), "tasks_done": sum(s.numCompletedTasks for s in stages), "over": self.over.is_set()}

    def _watch(self) -> None:
        while not self.over.wait(self.every):
            self.tell(self.counts())

    def __enter__(self) -> Progress:
        self.began = time.monotonic()
        self.thread = threading.Thread(target=self._watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()
        self.tell(self.counts())
