"""URL rules, by a sorted array of digests that workers share as a memory map.

The rules' 64-bit digests stand sorted in a file, their full strings after them. Spark gives each executor a copy of the
file, which all its workers map, so that its pages are in memory once; a new executor fetches it again. A batch of URLs
forms its candidate strings (each suffix of the host at a dot with each rule length of path), digests them, and finds
all of them with one vectorised binary search; a hit counts only if the stored string is the same.

A list beyond MOST bytes is not sent to every executor: its digests and those of the distinct URLs' candidates are sorted
and joined by Spark instead, with the same check of the strings.
"""

from __future__ import annotations

import hashlib
import mmap
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded, root

#: Bytes of rules that every executor may get.
MOST = 64 << 20
_OUT = "page_id long, host string, path string, rule string, verdict string"


class Rules:
    """(host, path, verdict) rules in a mapped file: count, digests, verdicts, ends of strings, strings."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(self.map, np.int64, 1)[0])
        self.keys = np.frombuffer(self.map, np.uint64, n, 8)
        self.allow = np.frombuffer(self.map, np.int64, n, 8 + 8 * n)
        self.ends = np.frombuffer(self.map, np.int64, n + 1, 8 + 16 * n)
        self.text = 8 + 16 * n + 8 * (n + 1)

    def string(self, i: int) -> bytes:
        return self.map[self.text + self.ends[i] : self.text + self.ends[i + 1]]

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Index of the rule with each string, else -1."""
        out = np.full(len(strings), -1)
        if not len(self.keys) or not strings:
            return out
        wanted = np.fromiter((xxhash.xxh64_intdigest(x) for x in strings), np.uint64, len(strings))
        low, high = (np.searchsorted(self.keys, wanted, side) for side in ("left", "right"))
        for i in np.flatnonzero(low < high):
            out[i] = next((k for k in range(low[i], high[i]) if self.string(k) == strings[i]), -1)
        return out


def _shared(spark: SparkSession, data: bytes) -> str:
    """Name under which every executor finds the bytes: the driver writes them to the shared folder, from which Spark hands them out."""
    name = f"rules-{hashlib.blake2b(data, digest_size=12).hexdigest()}"
    jvm, context = spark._jvm, spark.sparkContext
    if not any(x.endswith(f"/{name}") for x in context.listFiles):
        path = jvm.org.apache.hadoop.fs.Path(f"{root(spark)}/{name}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out = files.create(path, True)
        try:
            out.write(data)
        finally:
            out.close()
        context.addFile(files.makeQualified(path).toString())
    return name


class Shape(NamedTuple):
    """The lengths that rules' paths have, and the greatest that a rule's host has: no other candidates are formed."""

    lengths: list[int]
    widest: int


def build(rules: Sequence[tuple[str, str, str]]) -> tuple[bytes, Shape]:
    """The rules' block and shape."""
    rows = sorted({(xxhash.xxh64_intdigest(x), x, v) for h, p, v in rules for x in [_rule(h, p)]})
    if bad := {v for _, _, v in rows} - {"allow", "block"}:
        raise ValueError(f"verdicts are allow or block, not {sorted(bad)}")
    ends = np.concatenate([[0], np.cumsum([len(x) for _, x, _ in rows])]).astype(np.int64)
    head = [np.array([len(rows)], np.int64), np.array([k for k, _, _ in rows], np.uint64), np.array([v == "allow" for _, _, v in rows], np.int64), ends]
    return b"".join([*(x.tobytes() for x in head), *(x for _, x, _ in rows)]), Shape(sorted({len(p) for _, p, _ in rules}), max((len(h) for h, _, _ in rules), default=0))


def _rule(host: str, path: str) -> bytes:
    # hosts hold no "/", so that the string tells the two apart; a path without its "/" gets a mark
    return f"{host}{path}".encode() if path.startswith("/") else f"{host}\0{path}".encode()


_UPPER = {i: i + 32 for i in range(0x41, 0x5B)}


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_UPPER), path


def _candidates(host: str, path: str, shape: Shape) -> list[bytes]:
    """The strings of all rules that would fit a URL: of its host the suffixes at a dot that are no longer than a rule's."""
    out, suffix = [], host if len(host) <= shape.widest else host[-shape.widest - 1 :].partition(".")[2]
    while suffix:
        out += [_rule(suffix, path[:n]) for n in shape.lengths if n <= len(path)]
        suffix = suffix.partition(".")[2]
    return out


def _judging(name: str, shape: Shape, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(SparkFiles.get(name))
        for batch in batches:
            urls = [split(x) for x in batch["url"].to_pylist()]
            of, strings = [], []
            for i, (host, path) in enumerate(urls):
                own = _candidates(host, path, shape)
                of += [i] * len(own)
                strings += own
            hits = rules.find(strings)
            best: list[int] = [-1] * len(urls)
            long = [-1] * len(urls)
            for k in np.flatnonzero(hits >= 0):
                if len(strings[k]) > long[of[k]]:
                    best[of[k]], long[of[k]] = int(hits[k]), len(strings[k])
            yield pa.RecordBatch.from_arrays([
                batch["page_id"], pa.array([h for h, _ in urls], pa.string()), pa.array([p for _, p in urls], pa.string()),
                pa.array([None if k < 0 else rules.string(k).replace(b"\0", b"").decode() for k in best], pa.string()),
                pa.array([default if k < 0 else ("block", "allow")[rules.allow[k]] for k in best], pa.string()),
            ], ["page_id", "host", "path", "rule", "verdict"])

    return run


def _forming(shape: Shape):
    """Host, path and candidate strings, with their digests, of each distinct URL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [split(x) for x in batch["url"].to_pylist()]
            own = [_candidates(h, p, shape) for h, p in urls]
            keys = [[xxhash.xxh64_intdigest(x) - (1 << 63) for x in each] for each in own]
            yield pa.RecordBatch.from_arrays([batch["url"], pa.array([h for h, _ in urls], pa.string()), pa.array([p for _, p in urls], pa.string()), pa.array(own, pa.list_(pa.binary())), pa.array(keys, pa.list_(pa.int64()))], ["url", "host", "path", "strings", "keys"])

    return run


def _digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        strings = [_rule(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(x) - (1 << 63) for x in strings], pa.int64()), pa.array(strings, pa.binary()), batch["verdict"]], ["key", "string", "verdict"])


def _joined(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts by a join of sorted digests, for lists of any size: distinct URLs meet the rules once.

    A candidate that very many URLs have ("com/") is one row when it meets the rules; the URLs that have it are then split by
    Spark's adaptive skew join, as it has one row on the other side.
    """
    rules = rules.select("host", "path", "verdict").distinct()
    lengths = sorted(r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect())  # distinct lengths of paths: few
    widest = rules.agg(F.max(F.length("host"))).first()[0] or 0
    listed = rules.mapInArrow(_digesting, "key long, string binary, verdict string")
    urls = rows.select("url").where("url IS NOT NULL").distinct().mapInArrow(_forming(Shape(lengths, widest)), "url string, host string, path string, strings array<binary>, keys array<long>")
    each = urls.select("url", F.explode(F.arrays_zip("keys", "strings")).alias("c")).select("url", F.col("c.keys").alias("key"), F.col("c.strings").alias("string"))
    hits = each.select("key", "string").distinct().join(listed.hint("merge"), ["key", "string"])
    best = each.join(hits, ["key", "string"]).groupBy("url").agg(F.max(F.struct(F.length("string").alias("n"), "string", "verdict")).alias("best"))
    judged = urls.select("url", "host", "path").join(best, "url", "left")
    out = rows.join(judged, "url", "left")
    name = F.decode(F.unhex(F.regexp_replace(F.hex("best.string"), "^((?:..)*?)00", "$1")), "UTF-8")
    return out.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), name.alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most: int = MOST) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per input row; other columns are not read.

    A rule (host, path, verdict) fits its host and all subdomains if the path starts with the rule's; of
    several the longest string decides. `default` is the verdict where none fits, since a URL that the
    array does not hold is not listed. A null URL, or one without "://", has an empty host and path, fits
    no rule and gets the default. Null ids, repeated rows and very long URLs are judged like others. No rows: no rows.
    Rules are a list, which is mapped, or a frame (host, path, verdict) of any size; beyond `most` bytes they are joined.
    """
    rows = bounded(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    if not isinstance(rules, DataFrame):
        data, shape = build(rules)
        if len(data) <= most:
            return rows.mapInArrow(_judging(_shared(pages.sparkSession, data), shape, default), _OUT)
        rules = pages.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
    return _joined(rows, rules, default)
