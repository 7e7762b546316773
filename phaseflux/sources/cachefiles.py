"""The label caches: tables dealt by the hash of their key, of which an upsert rewrites the parts that it touches.

A part is one bucket of Spark's own bucketing of `cache_key`. A version of a table is a manifest that names, for each part, the
write that holds it; an upsert writes the touched parts to a folder of its own, and then the next manifest. A run that dies in
between leaves the version before, and a reader has one version or the other. Versions are read as a bucketed table, so
that a join on the key moves the probing side only.
"""

from __future__ import annotations

import atexit
import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import cache_upsert

CLASSIFICATION = "cache_key string, modality string, disease_area string, modality_confidence double, disease_confidence double, reasoning string, created_at string"
ADJUDICATION = "cache_key string, outcome string, confidence double, reasoning string, evidence_sources array<string>, approval_date date, market_date date, created_at string"
#: Parts of a new table; an old one keeps its own number.
PARTS = 64
_named: list[tuple[SparkSession, str]] = []


class Caches(NamedTuple):
    classification: DataFrame
    adjudication: DataFrame


def part(parts: int) -> Column:
    """The part of a row: Spark's bucket of its key."""
    return F.pmod(F.hash("cache_key"), F.lit(parts))


class Cache:
    """One table of labels below a folder, keyed by `cache_key`."""

    def __init__(self, spark: SparkSession, path: str, schema: str, parts: int = PARTS):
        self.spark, self.path, self.schema, self._parts = spark, path.rstrip("/"), schema, parts

    def _files(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifest(self, version: int) -> dict | None:
        """A version's manifest; None if it is not complete."""
        try:
            return json.loads(self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0])
        except (ValueError, TypeError):
            return None

    def _written(self) -> list[int]:
        files, at = self._files(f"{self.path}/versions")
        names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def versions(self) -> list[int]:
        """The complete versions."""
        return [x for x in self._written() if self._manifest(x)]

    def _newest(self) -> dict:
        for version in reversed(self._written()):
            if found := self._manifest(version):
                return found
        return {"parts": self._parts, "places": {}}

    def _table(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        """The rows of a manifest's parts, bucketed by key."""
        spark, name = self.spark, f"label_cache_{uuid.uuid4().hex}"
        places = {int(k): v for k, v in manifest["places"].items() if only is None or int(k) in only}
        columns = [x.strip() for x in self.schema.split(", ")]
        if not places:
            return spark.createDataFrame([], self.schema)
        spark.sql(f"CREATE TABLE {name} ({', '.join(columns)}, part INT) USING parquet PARTITIONED BY (part) CLUSTERED BY (cache_key) INTO {manifest['parts']} BUCKETS LOCATION '{self.path}/none'")
        _named.append((spark, name))
        spark.sql(f"ALTER TABLE {name} ADD {' '.join(f"PARTITION (part={k}) LOCATION '{self.path}/data/{v}/part={k}'" for k, v in places.items())}")
        return spark.table(name).drop("part")

    def read(self) -> DataFrame:
        """The newest version."""
        return self._table(self._newest())

    def upsert(self, new: DataFrame) -> set[int]:
        """Puts entries in place of those of the same keys, as cache_upsert() does; returns the parts that were rewritten."""
        spark, manifest = self.spark, self._newest()
        n, name, write = manifest["parts"], f"label_cache_{uuid.uuid4().hex}", uuid.uuid4().hex
        touched = {r[0] for r in new.select(part(n)).distinct().collect()}  # numbers of parts
        if not touched:
            return touched
        columns = [x.split()[0] for x in self.schema.split(", ")]
        rows = cache_upsert(self._table(manifest, touched), new.select(*columns)).select(*columns, part(n).cast("int").alias("part"))
        try:
            rows.repartition(n, "cache_key").write.partitionBy("part").bucketBy(n, "cache_key").option("path", f"{self.path}/data/{write}").format("parquet").saveAsTable(name)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay
        self._commit(manifest | {"places": manifest["places"] | {str(k): write for k in touched}})
        return touched

    def renew(self) -> None:
        """The newest version again under the next number."""
        self._commit(self._newest())

    def _commit(self, manifest: dict) -> None:
        """The next version; a second writer of the same version fails."""
        version = max(self._written(), default=-1) + 1
        files, at = self._files(f"{self.path}/versions/{version}.json")
        out = files.create(at, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True), "utf-8"))
        finally:
            out.close()

    def migrate(self, changed: DataFrame) -> set[int]:
        """Rewrites the parts of changed rows."""
        return self.upsert(changed)

    def vacuum(self) -> int:
        """Deletes versions before the newest, and writes that it does not name; returns how many folders went. No reader may be at work."""
        newest, written = self._newest(), self._written()
        files, data = self._files(f"{self.path}/data")
        gone = [x.getPath() for x in files.listStatus(data) if x.getPath().getName() not in newest["places"].values()] if files.exists(data) else []
        for x in self.versions()[:-1]:
            written.remove(x)
            files.delete(self._files(f"{self.path}/versions/{x}.json")[1], False)
        for x in gone:
            files.delete(x, True)
        return len(gone)


@atexit.register
def _forget() -> None:
    """Drops the names of tables that were read; their files stay."""
    for spark, name in _named:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except (Py4JError, OSError, AttributeError):  # the session has ended before
            return


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of the table below a folder."""
    return Cache(spark, path, "cache_key string").versions()


def caches(spark: SparkSession, path: str) -> tuple[Cache, Cache]:
    return Cache(spark, f"{path}/classification", CLASSIFICATION), Cache(spark, f"{path}/adjudication", ADJUDICATION)


def read(spark: SparkSession, path: str | None) -> Caches:
    """The newest versions; empty tables without any."""
    if path:
        return Caches(*(x.read() for x in caches(spark, path)))
    return Caches(*(spark.createDataFrame([], x) for x in (CLASSIFICATION, ADJUDICATION)))


def write(path: str | None, classification: DataFrame, adjudication: DataFrame) -> None:
    """Upserts the new entries of each, a version for each run, also for one that has found everything; versions before stay until vacuum()."""
    if path:
        for cache, new in zip(caches(classification.sparkSession, path), (classification, adjudication), strict=True):
            if not cache.upsert(new):
                cache.renew()
