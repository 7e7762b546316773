"""Frames that are made once and then read: results of calls that cost money or may differ when they are repeated."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or f"file://{tempfile.gettempdir()}/checkpoints/phaseflux").rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder with all that it holds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_kept: list[tuple[SparkSession, str]] = []


def kept(frame: DataFrame) -> DataFrame:
    """The frame from a table of its own in the shared folder, so that a lost executor repeats nothing before it.

    Columns are packed, and a reader takes those that it needs; a checkpoint would hold whole rows as they lie in memory.
    The files stay until the interpreter ends.
    """
    spark = frame.sparkSession
    path = f"{folder(spark)}/kept-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@atexit.register
def _forget() -> None:
    for spark, path in _kept:
        try:
            delete(spark, path)
        except (Py4JError, OSError, AttributeError):  # the session has ended before
            return
