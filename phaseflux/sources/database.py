"""The registry's database by JDBC."""

from __future__ import annotations

import logging
import math
import os
import re
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..operators import ingest

log = logging.getLogger(__name__)
#: Rows that a connection reads at least, and connections at most, of one table.
ROWS, CONNECTIONS = 250_000, 64
#: Tables that a scan reads.
TABLES = ("studies", "interventions", "conditions", "sponsors", "browse_interventions", "browse_conditions", "mesh_terms", "brief_summaries")


@dataclass(frozen=True)
class Config:
    """Where the database is. `url` overrides host, port and name, and goes without a user."""

    host: str = "localhost"
    port: int = 5432
    name: str = "aact"
    user: str | None = None
    password: str | None = None
    schema: str = "ctgov"
    sslmode: str = "prefer"
    url: str | None = None

    def check(self) -> None:
        if not self.url and not self.user:
            raise ValueError("the database needs a user: set REGISTRY_DB_USER or pass user")
        if not self.url and not self.password:
            raise ValueError("the database needs a password: set REGISTRY_DB_PASSWORD or pass password")

    def options(self) -> dict[str, str]:
        self.check()
        if self.url:
            return {"url": self.url}
        place = f"jdbc:postgresql://{self.host}:{self.port}/{self.name}?sslmode={self.sslmode}"
        return {"url": place, "user": self.user, "password": self.password, "sessionInitStatement": f"SET search_path TO {self.schema}, public"}


def configured(**given: str | int | None) -> Config:
    """The configuration: what is given, else REGISTRY_DB_HOST, _PORT, _NAME, _USER, _PASSWORD, _SCHEMA, _SSLMODE, _URL, else defaults."""
    found = {k: os.environ.get(f"REGISTRY_DB_{k.upper()}") for k in Config.__dataclass_fields__}
    values = {k: v for k, v in (found | {k: v for k, v in given.items() if v is not None}).items() if v is not None}
    return replace(Config(), **values | ({"port": int(values["port"])} if "port" in values else {}))


def _unreachable(error: Exception) -> RuntimeError:
    if "SQL" not in str(error) and "onnect" not in str(error):
        raise error
    return RuntimeError("the registry's database can't be read; check REGISTRY_DB_USER and REGISTRY_DB_PASSWORD or pass a configuration")


def query(spark: SparkSession, sql: str, config: Config | None = None) -> DataFrame:
    """A query's result; an unreachable database is a RuntimeError."""
    options = (config or configured()).options()
    try:
        return spark.read.format("jdbc").options(query=sql, **options).load()
    except (Py4JJavaError, PySparkException) as error:
        raise _unreachable(error) from error


def ranges(key: str, low: str | None, high: str | None, n: int) -> list[str]:
    """Conditions that deal all rows to n ranges of a key, nulls to the first: every row meets exactly one.

    Bounds lie evenly between the least and the greatest key, both of one start and as many digits (as registries number their
    studies); keys of any other form in between are dealt by their order. Without such bounds there is one range.
    """
    forms = [re.fullmatch(r"(.*?)(\d+)", x or "") for x in (low, high)]
    if n < 2 or not all(forms) or forms[0][1] != forms[1][1] or len(low) != len(high):
        return ["1 = 1"]
    start, first, last = forms[0][1].replace("'", "''"), int(forms[0][2]), int(forms[1][2])
    bounds = [f"'{start}{x:0{len(forms[0][2])}d}'" for x in sorted({first + (last - first + 1) * i // n for i in range(1, n)} - {first})]
    if not bounds:
        return ["1 = 1"]
    return [f"{key} < {bounds[0]} OR {key} IS NULL", *(f"{key} >= {a} AND {key} < {b}" for a, b in zip(bounds, bounds[1:], strict=False)), f"{key} >= {bounds[-1]}"]


def table(spark: SparkSession, name: str, config: Config | None = None, key: str = "nct_id", rows: int = ROWS, connections: int = CONNECTIONS) -> DataFrame:
    """A table by as many connections as its rows are worth, each a range of the key, from bounds that one small query asks for.

    Columns and simple conditions reach the database with each range's own. Tables without the key, or with keys that
    are no numbers, are one range, which is told.
    """
    options = (config or configured()).options()
    try:
        plain = spark.read.format("jdbc").options(dbtable=name, **options).load()
        own = next((c for c in plain.columns if c.lower() == key.lower()), None)
        if own is None:
            return plain
        bounds = query(spark, f"SELECT COUNT(*) AS n, MIN({own}) AS low, MAX({own}) AS high FROM {name}", config).first()
        n = min(connections, math.ceil(bounds[0] / rows))
        parts = ranges(own, *(None if x is None else str(x) for x in bounds[1:]), n)
        if len(parts) < n:
            log.warning("%s is read by %d of %d connections: its keys from %s to %s have no even ranges", name, len(parts), n, *bounds[1:])
        url = options.pop("url")
        return spark.read.jdbc(url, name, predicates=parts, properties=options)
    except (Py4JJavaError, PySparkException) as error:
        raise _unreachable(error) from error


def fetch_all(spark: SparkSession, sql: str, config: Config | None = None) -> list[dict]:
    """All rows of a small result."""
    return [r.asDict() for r in query(spark, sql, config).collect()]


def fetch_one(spark: SparkSession, sql: str, config: Config | None = None) -> dict | None:
    row = query(spark, sql, config).first()
    return row.asDict() if row else None


def execute(spark: SparkSession, sql: str, config: Config | None = None) -> None:
    """Runs a statement that returns nothing, and commits it."""
    options = (config or configured()).options()
    properties = spark._jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            properties.setProperty(k, options[k])
    connection = spark._jvm.java.sql.DriverManager.getConnection(options["url"], properties)
    try:
        statement = connection.createStatement()
        if "sessionInitStatement" in options:
            statement.execute(options["sessionInitStatement"])
        statement.execute(sql)
        if not connection.getAutoCommit():
            connection.commit()
    finally:
        connection.close()


def check_connection(spark: SparkSession, config: Config | None = None) -> dict:
    """How many studies the database has; nothing at all is an error."""
    row = fetch_one(spark, "SELECT COUNT(*) AS study_count FROM studies", config)
    if row is None:
        raise RuntimeError("the database gave no row")
    return {k.lower(): v for k, v in row.items()}


def fetch(spark: SparkSession, source: str = "database", config: Config | None = None, path: str | None = None, mesh_term: str | None = None, keywords: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """ingest.scan() of the database's tables, or of Parquet tables below `path`; a cap is told, and told again when it is met."""
    if source == "api":
        raise NotImplementedError("the REST source is not implemented")
    if source not in ("database", "parquet"):
        raise ValueError(f"unknown source {source!r}")
    if most is not None:
        log.warning("at most %d joined rows are read", most)
    read = (lambda t: table(spark, t, config)) if source == "database" else (lambda t: spark.read.parquet(f"{path}/{t}.parquet"))
    rows = ingest.scan({t: read(t) for t in TABLES}, mesh_term, keywords, most)
    if most is not None and rows.count() >= most:  # `most` rows at most
        log.warning("the cap of %d rows was met: the result is cut", most)
    return rows
