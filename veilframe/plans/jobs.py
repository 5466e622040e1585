"""Runs that can be cancelled: each under its own job group, at most one at a time for a session."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


class Cancelled(Exception):
    """The run was cancelled before or while it went."""


class Runs:
    """The runs of one session, in turn. A cancelled id stops at the next checkpoint, or in Spark where its jobs go."""

    def __init__(self, spark: SparkSession):
        self.spark, self._turn, self._cancelled = spark, threading.Lock(), set()

    def cancel(self, run_id: str) -> None:
        self._cancelled.add(run_id)
        self.spark.sparkContext.cancelJobGroup(run_id)

    def check(self, run_id: str) -> None:
        if run_id in self._cancelled:
            raise Cancelled(run_id)

    def run(self, run_id: str, action: Callable[[], T]) -> T:
        """action() under the run's job group, once no other run of this session goes."""
        with self._turn:
            self.check(run_id)
            sc = self.spark.sparkContext
            sc.setJobGroup(run_id, run_id, interruptOnCancel=True)
            try:
                out = action()
            except Exception as e:
                if run_id in self._cancelled:
                    raise Cancelled(run_id) from e
                raise
            finally:
                sc.setLocalProperty("spark.jobGroup.id", None)
            self.check(run_id)
            return out
