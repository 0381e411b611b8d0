"""Submit independent Spark jobs at the same time."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


AT_ONCE = 8


def together(*jobs: Callable[[], Any]) -> list[Any]:
    """Results of the jobs, in order. Spark shares its executors among them, so
    the tail of one job does not leave the cluster idle."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    in_session = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(min(len(jobs), AT_ONCE)) as pool:
        return [f.result() for f in [pool.submit(in_session(job)) for job in jobs]]
