"""A journal of answered requests: what was paid for is on disk before the next request is sent.

A task appends its answers to a file of its own, a line each, where a file system shows what is written before a file is closed (local
and mounted ones); elsewhere each answer is a file, named by the request's hash and moved into place when it is complete. So a
task, a run or a machine that dies loses the request in flight at most. seal() turns the files into Parquet. A folder is
open (files by task or request), sealed (files that are being turned) or closed (Parquet); a request may be in several, with the same answer.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "reply string, input_tokens long, output_tokens long, cache_write long, cache_read long"
SCHEMA = f"request string, {ANSWER}"


def request(*parts: Column) -> Column:
    """A request's name: the digest of all that the model is told, and of what else tells requests apart."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def _read(spark: SparkSession, *paths: str) -> DataFrame:
    """The answers of files by task or request, without lines that were cut off."""
    return spark.read.schema(SCHEMA).json(list(paths), recursiveFileLookup=True, pathGlobFilter="*.json").where("request IS NOT NULL AND reply IS NOT NULL")


@dataclass(frozen=True)
class Journal:
    """The journal below a folder that executors reach by the same path: a local one, or a URI that pyarrow knows."""

    path: str

    def _at(self) -> tuple[fs.FileSystem, str]:
        files, at = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return files, at.rstrip("/")

    def get(self, name: str) -> dict | None:
        """An answer among the open files, for a task that runs again."""
        files, at = self._at()
        try:
            with files.open_input_stream(f"{at}/open/{name[:2]}/{name}.json") as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return None

    def put(self, name: str, answer: dict) -> None:
        files, at = self._at()
        folder = f"{at}/open/{name[:2]}"
        files.create_dir(folder, recursive=True)
        part = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(part) as file:
            file.write(json.dumps({"request": name} | answer).encode())
        files.move(part, f"{folder}/{name}.json")

    @contextlib.contextmanager
    def of_task(self) -> Iterator[tuple[Callable[[str], dict | None], Callable[[str, dict], None]]]:
        """get() and put() of a task. Its file is in a folder of its number, where the same task finds it when it runs again; a line that
        was cut off as a task died is no answer."""
        files, at = self._at()
        if not isinstance(files, fs.LocalFileSystem):
            yield self.get, self.put
            return
        folder, known = f"{at}/open/task-{TaskContext.get().partitionId()}", {}
        for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            with files.open_input_stream(info.path) as file:
                for line in file.read().split(b"\n"):
                    with contextlib.suppress(ValueError):
                        found = json.loads(line)
                        known[found.pop("request")] = found
        files.create_dir(folder, recursive=True)
        with open(f"{folder}/{uuid.uuid4().hex}.json", "xb", buffering=0) as out:
            yield known.get, lambda name, answer: out.write(json.dumps({"request": name} | answer).encode() + b"\n")

    def answers(self, spark: SparkSession) -> DataFrame:
        """(request, answer) of all requests that were answered, once each; no rows where there is no journal yet."""
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(hadoop)] if files.exists(hadoop) else []
        plain = [f"{self.path}/{x}" for x in names if x == "open" or x.startswith("sealed-")]
        out = spark.createDataFrame([], SCHEMA)
        if plain:
            out = out.union(_read(spark, *plain))
        if "closed" in names:
            out = out.union(spark.read.schema(SCHEMA).parquet(f"{self.path}/closed"))
        return out.dropDuplicates(["request"])

    def seal(self, spark: SparkSession) -> None:
        """Turns the files by request into Parquet. No task may write meanwhile; if this dies, nothing is lost: calling it again repeats what was not done."""
        files, at = self._at()
        if files.get_file_info(f"{at}/open").type != fs.FileType.NotFound:
            files.move(f"{at}/open", f"{at}/sealed-{uuid.uuid4().hex}")
        for info in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if info.base_name.startswith("sealed-"):
                _read(spark, f"{self.path}/{info.base_name}").write.mode("append").parquet(f"{self.path}/closed")
                files.delete_dir(info.path)
