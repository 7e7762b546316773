"""Centroid clustering in exact integer arithmetic, whatever the number of tasks or the order of their sums.

Vectors are quantised to integers. A block's squared distances are one matrix product by |x|^2 - 2 x.c + |c|^2 in float64; every
number in it is an integer below 2^53, so the product is exact. Rows or centroids beyond the guard of magnitudes take int64, and
beyond that Python's integers. A round is one treeAggregate of sums and counts (as many integers as the centroids have), so
nothing that grows with the table reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

BLOCK = 4096
#: Squared distances of the result are cut here, as the column is a long.
MOST = (1 << 63) - 1
SCHEMA = "vec_id long, cluster int, distance long"


def _guards(dims: int) -> tuple[int, int]:
    """Below these magnitudes of a row and a centroid a sum of squared differences stays below 2^53, or 2^63."""
    return math.isqrt((1 << 51) // dims), math.isqrt((1 << 61) // dims)


def _whole(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python's integers; also where the product of doubles is infinite."""
    out = [[math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale for x in row] for row in rows.tolist()]
    return np.array(out, object).reshape(rows.shape)


def nearest(rows: np.ndarray, centroids: list[list[int]], scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row of doubles, the smaller one at a tie, and the exact squared distance (an object array where a long can't hold it)."""
    n, dims = rows.shape
    exact, long = _guards(dims)
    with np.errstate(over="ignore"):
        points = np.floor(rows * scale)
    size = np.abs(points).max(axis=1, initial=0)
    reach = [max(map(abs, c), default=0) for c in centroids]
    wide = max(reach, default=0) >= long or bool((size >= long).any())
    out = np.zeros((n, len(centroids)), object if wide else np.int64)
    low = np.flatnonzero(size < exact)
    near = [k for k, r in enumerate(reach) if r < exact]
    if len(low) and near:
        x, c = points[low], np.array([centroids[k] for k in near], np.float64)
        got = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
        out[np.ix_(low, near)] = got.astype(np.int64)
    mid = np.flatnonzero(size < long)
    if len(mid):
        x = points[mid].astype(np.int64)
        high = size[mid] >= exact
        for k, r in enumerate(reach):
            part = np.flatnonzero(high) if r < exact else np.arange(len(mid)) if r < long else []
            if len(part):
                out[mid[part], k] = ((x[part] - np.array(centroids[k], np.int64)) ** 2).sum(axis=1)
    if wide:
        for k, r in enumerate(reach):
            part = np.arange(n) if r >= long else np.flatnonzero(size >= long)
            if len(part):
                gap = _whole(rows[part], scale) - np.array(centroids[k], object)
                out[part, k] = (gap * gap).sum(axis=1)
    best = out.argmin(axis=1)
    return best, out[np.arange(n), best]


class _Sums:
    """Of each cluster: componentwise sum, number of vectors, sum of distances; all exact."""

    def __init__(self, k: int, dims: int):
        self.total, self.count, self.inertia = np.zeros((k, dims), object), [0] * k, [0] * k

    def add(self, rows: np.ndarray, centroids: list[list[int]], scale: int) -> _Sums:
        best, distance = nearest(rows, centroids, scale)
        k, (exact, _) = len(centroids), _guards(rows.shape[1])
        with np.errstate(over="ignore"):
            points = np.floor(rows * scale)
        low = np.abs(points).max(axis=1, initial=0) < exact
        member = np.zeros((k, int(low.sum())))
        member[best[low], np.arange(member.shape[1])] = 1
        self.total = self.total + (member @ points[low]).astype(np.int64).astype(object)  # at most BLOCK times the guard: below 2^53
        high = np.flatnonzero(~low)
        for at, whole in zip(high, _whole(rows[high], scale), strict=True):
            self.total[best[at]] = self.total[best[at]] + whole
        for c, d in zip(best.tolist(), distance.tolist(), strict=True):
            self.count[c] += 1
            self.inertia[c] += d
        return self

    def merge(self, other: _Sums) -> _Sums:
        self.total = self.total + other.total
        self.count = [a + b for a, b in zip(self.count, other.count, strict=True)]
        self.inertia = [a + b for a, b in zip(self.inertia, other.inertia, strict=True)]
        return self


def _packed(dims: int):
    """Keeps the vectors of `dims` finite components, each as the bytes of its doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False))
            flat = batch.column("vector").flatten()
            x = np.asarray(pc.fill_null(flat, math.nan), np.float64).reshape(-1, dims)
            good = np.isfinite(x).all(axis=1)
            data = pa.array([row.tobytes() for row in x[good]], pa.binary())
            yield pa.record_batch([batch.column("vec_id").filter(pa.array(good)), data], ["vec_id", "data"])

    return pack


def _matrix(data: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(-1, dims)


def _blocks(dims: int):
    """Matrices of at most BLOCK rows from the rows of a partition."""

    def block(rows: Iterator) -> Iterator[np.ndarray]:
        held: list[bytes] = []
        for row in rows:
            held.append(bytes(row[0]))
            if len(held) == BLOCK:
                yield _matrix(held, dims)
                held = []
        if held:
            yield _matrix(held, dims)

    return block


def _assigned(centroids: list[list[int]], dims: int, scale: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                best, distance = nearest(_matrix(part.column("data").to_pylist(), dims), centroids, scale)
                yield pa.record_batch([part.column("vec_id"), pa.array(best, pa.int32()), pa.array([min(int(d), MOST) for d in distance], pa.int64())], ["vec_id", "cluster", "distance"])

    return assign


def cluster(vectors: DataFrame, scratch: Scratch, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> DataFrame:
    """Every vector of `dims` finite components with its cluster.

    Returns vec_id, cluster int, distance long (squared, in units of 1/scale), cluster_inertia long, inertia long and centroid
    array<string> (its components as decimal integers). A component x counts as floor(scale * x). The first centroids are the k
    vectors with the smallest sha256 of `seed:vec_id`; each of `rounds` rounds assigns all vectors, a tie going to the smaller
    number, and moves every centroid that has vectors to the floor of their mean.

    Vectors that are null, of other lengths, or hold null or non-finite components have no row in the result. A null id counts as
    an empty text in the digest and stays null; repeated rows are vectors of their own (among equal digests the smaller bytes of
    components go first); with fewer than k vectors there are fewer clusters, of an empty table none and no rows. Distances and
    inertias beyond a long are shown as its greatest value, but compared and summed exactly. Other columns are not read.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    kept = scratch.keep(plain.mapInArrow(_packed(dims), "vec_id long, data binary"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select("data", digest.alias("digest")).orderBy("digest", "data").limit(k).collect()
    centroids = [_whole(_matrix([bytes(r.data)], dims), scale)[0].tolist() for r in first]
    if not centroids:
        return spark.createDataFrame([], f"{SCHEMA}, cluster_inertia long, inertia long, centroid array<string>")
    blocks = kept.select("data").rdd.mapPartitions(_blocks(dims))

    def summed() -> _Sums:
        held = centroids
        return blocks.treeAggregate(_Sums(len(held), dims), lambda sums, rows: sums.add(rows, held, scale), lambda a, b: a.merge(b))

    for _ in range(rounds):
        sums = summed()
        centroids = [[int(x) // n for x in total] if n else old for total, n, old in zip(sums.total.tolist(), sums.count, centroids, strict=True)]
    inertia = summed().inertia
    facts = [(c, min(one, MOST), min(sum(inertia), MOST), [str(x) for x in centroid]) for c, (one, centroid) in enumerate(zip(inertia, centroids, strict=True))]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<string>")
    out = kept.mapInArrow(_assigned(centroids, dims, scale), SCHEMA).join(F.broadcast(named), "cluster")  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
