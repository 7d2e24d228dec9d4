"""Progress of a run: events while Spark's tasks finish, the last of each dataset and window once its result is written."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class ProgressEvent:
    """``done`` of ``total`` points of a dataset and window in a batch; ``share`` of the tasks known so far that are done."""

    batch_id: str
    dataset: str
    window_m: int | None
    done: int
    total: int
    share: float = 0.0


Callback = Callable[[ProgressEvent], None]


def emit(callback: Callback | None, event: ProgressEvent, quiet: bool = False) -> None:
    if callback:
        callback(event)
    if not quiet and event.done == event.total:
        print(f"{event.batch_id}: {event.dataset} {event.window_m or ''} {event.done}/{event.total}")


def tasks_done(spark: SparkSession, group: str) -> tuple[int, int]:
    """Finished and known tasks of a job group's jobs, by Spark's status tracker."""
    tracker = spark.sparkContext.statusTracker()
    done = known = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            if s := tracker.getStageInfo(stage):
                done, known = done + s.numCompletedTasks, known + s.numTasks
            elif info.status == "SUCCEEDED":
                continue  # skipped, or no longer kept
    return done, known


@contextmanager
def watched(spark: SparkSession, tell: Callable[[float], None] | None, every: float = 0.5) -> Iterator[None]:
    """Call ``tell`` with the share of finished tasks of the jobs started within, as it rises (below 1).

    The jobs are told apart by a group of their own, set for this thread and its former value put back.  ``tell`` is
    called in another thread; an error of its ends the watching, not the work.
    """
    if tell is None:
        yield
        return
    sc, group, stop = spark.sparkContext, f"terrasample-{uuid.uuid4().hex}", threading.Event()
    before = sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.job.description")
    sc.setJobGroup(group, "terrasample extract")

    def look() -> None:
        last = 0.0
        while not stop.wait(every):
            done, known = tasks_done(spark, group)
            share = min(done / known, 0.99) if known else 0.0
            if share > last:
                last = share
                tell(share)

    watcher = threading.Thread(target=look, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        stop.set()
        watcher.join()
        sc.setLocalProperty("spark.jobGroup.id", before[0])
        sc.setLocalProperty("spark.job.description", before[1])
