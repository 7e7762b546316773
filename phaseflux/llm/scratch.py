"""Intermediate tables in the folder that every executor shares.

Operators cut long lineages by writing a table and reading it again, so that a lost executor costs one
stage and not the whole history. The folder is spark.checkpoint.dir; only where that is unset and the master is this
machine alone (tests) a folder of the machine is taken.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from types import TracebackType

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of input that a task gets at least, where they are known; bytes of an Arrow batch and rows of a column batch at most.
ROWS, LEAST, BATCH, COLUMNS = 16_384, 4 << 20, 4 << 20, 512
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: set[Scratch] = set()


def root(spark: SparkSession) -> str:
    """The shared folder. On a cluster without one this raises: rows in executors' own folders would be lost unseen."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (shared or f"file://{tempfile.gettempdir()}/checkpoints/phaseflux").rstrip("/")


def bounded(frame: DataFrame) -> DataFrame:
    """The frame in tasks of LEAST bytes of input or more, after its session's limits for batches were lowered.

    Of an Arrow batch a worker holds one or two, its JVM as much again (Spark's default is 64 MB); a reader of Parquet holds
    so many whole texts at once. Smaller limits stay as they are; a row beyond the limit is a batch. Partitions of LEAST
    bytes or more are not touched: at 128 MB a partition the number of tasks stays what it is.
    """
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not re.fullmatch(r"\d+b?", held := conf.get(key)) or int(held.rstrip("b")) > BATCH:  # with a greater unit it is larger
        conf.set(key, str(BATCH))
    if int(conf.get(key := "spark.sql.parquet.columnarReaderBatchSize")) > COLUMNS:
        conf.set(key, str(COLUMNS))
    return gathered(frame, size(frame))


def size(frame: DataFrame) -> int:
    """Bytes of a frame by Spark's estimate: for files those of the columns that are read."""
    return frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def gathered(frame: DataFrame, total: int) -> DataFrame:
    """A frame made from so many bytes, in no more partitions than that is worth."""
    return frame.coalesce(min(max(1, -(-total // LEAST)), 1 << 30))


@contextmanager
def held(spark: SparkSession, settings: dict[str, str | int]) -> Iterator[None]:
    """Settings of the session for the actions within, and what was set before after them."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables of one call of an operator. close() deletes them, once nothing that was made from them will be read again.

    As a context manager it closes itself; one that nobody closes is closed when the interpreter ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self._n = spark, f"{root(spark)}/tables-{uuid.uuid4().hex}", 0
        _open.add(self)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.close()

    def keep(self, frame: DataFrame, replaces: DataFrame | None = None, rows: int | None = None) -> DataFrame:
        """The same rows, read from a table written now; `replaces`, an earlier table, is deleted then.

        `rows` is a bound of their number: the table then has no more files than that many rows are worth.
        """
        self._n += 1
        path = f"{self.path}/{self._n}"
        out = frame if rows is None else frame.coalesce(max(1, -(-rows // ROWS)))
        conf, before = self.spark.conf, self.spark.conf.get(_CLEAN)
        conf.set(_CLEAN, "true")  # nothing reads the shuffles of this write again: they go when it ends
        try:
            out.write.parquet(path)
        finally:
            conf.set(_CLEAN, before)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._kept_at = path
        if replaces is not None:
            self.drop(replaces)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._delete(frame._kept_at)

    def _delete(self, path: str) -> None:
        spark = self.spark
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        _open.discard(self)
        if self._n:
            self._delete(self.path)


@atexit.register
def _close_all() -> None:
    for one in list(_open):
        try:
            one.close()
        except (Py4JError, OSError, AttributeError):  # the session has ended before
            _open.discard(one)


def fresh(name: str, frame: DataFrame) -> str:
    """A column name that the frame has not."""
    taken = {x.lower() for x in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
