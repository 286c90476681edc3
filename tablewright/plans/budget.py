"""Time budgets that end running work: jobs carry a tag and are cancelled when the time is up."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")

#: Seconds between two cancellations, so that jobs begun after the first one end too.
AGAIN = 0.5
POOL = "spark.scheduler.pool"


class BudgetSpent(TimeoutError):
    """The work did not end within its seconds."""


def within(spark: SparkSession, seconds: float | None, work: Callable[[], T]) -> T:
    """work() of this thread; its Spark jobs are cancelled when the seconds are up, and BudgetSpent is raised.

    Only jobs of this call are cancelled. Between two jobs the driver's own code runs on until the next job.
    """
    if seconds is None:
        return work()
    if seconds <= 0:
        raise BudgetSpent("No time is left.")
    context, tag, done, late = spark.sparkContext, f"budget-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(seconds):
            return
        late.set()
        while not done.is_set():
            context.cancelJobsWithTag(tag)
            done.wait(AGAIN)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    watcher.start()
    try:
        out = work()
    except Exception as problem:
        if late.is_set():
            raise BudgetSpent(f"Stopped after {seconds:.3g} seconds.") from problem
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
        context.setInterruptOnCancel(False)
    if late.is_set():
        raise BudgetSpent(f"Ended after its {seconds:.3g} seconds.")
    return out


def left(deadline: float | None) -> float | None:
    """Seconds until a moment of time.monotonic()."""
    return None if deadline is None else deadline - time.monotonic()


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], T]], threads: int) -> list[T]:
    """Results of the tasks, run on some driver threads; each has a pool of its own, for sessions that schedule fairly."""
    def pooled(number: int, task: Callable[[], T]) -> Callable[[], T]:
        def run() -> T:
            context = spark.sparkContext
            context.setLocalProperty(POOL, f"task-{number % threads}")
            try:
                return task()
            finally:
                context.setLocalProperty(POOL, None)
        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(max(1, threads)) as pool:
        return [f.result() for f in [pool.submit(pooled(k, t)) for k, t in enumerate(tasks)]]
