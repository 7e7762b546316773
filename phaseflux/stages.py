"""Spark jobs of independent stages side by side in one session."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

_SPANS = "stage string, began double, ended double, failed boolean"


class Ran(NamedTuple):
    """Each stage's result by its name, and a row of when it ran (seconds after the first began)."""

    results: dict[str, Any]
    spans: DataFrame


def run(spark: SparkSession, stages: dict[str, Callable[[], Any]], together: bool = True) -> Ran:
    """Runs every stage: together, each in a thread and a scheduler pool of its own, or one after the other in the given order.

    A stage's jobs are those that it starts itself; what it returns lazily runs later and elsewhere. The first error ends the
    jobs of the other stages and reaches the caller as it is. Pools share executors evenly where spark.scheduler.mode is
    FAIR; in the default mode a later stage takes what the earlier ones leave free.
    """
    context, tag = spark.sparkContext, f"stages-{uuid.uuid4().hex}"
    results: dict[str, Any] = {}
    spans: dict[str, list] = {}
    errors: list[BaseException] = []
    start = time.monotonic()

    def one(name: str) -> None:
        pool = context.getLocalProperty("spark.scheduler.pool")
        context.setLocalProperty("spark.scheduler.pool", name)
        context.addJobTag(tag)
        spans[name] = [name, time.monotonic() - start, None, True]
        try:
            results[name] = stages[name]()
            spans[name][3] = False
        except BaseException as error:  # raised again below, in the caller's thread
            errors.append(error)
            if together:
                context.cancelJobsWithTag(tag)
        finally:
            spans[name][2] = time.monotonic() - start
            context.removeJobTag(tag)
            context.setLocalProperty("spark.scheduler.pool", pool)

    if together:
        threads = [InheritableThread(target=one, args=(name,)) for name in stages]
        for x in threads:
            x.start()
        for x in threads:
            x.join()
    else:
        for name in stages:
            one(name)
            if errors:
                break
    if errors:
        raise errors[0]
    return Ran(results, spark.createDataFrame([tuple(spans[name]) for name in stages], _SPANS))
