"""Near duplicates of vectors, by sorted projection passes.

Equal vectors count as one from the start. A pass orders the vectors of a label by a key of concatenated random projection
signs and compares each with the next ones in that order, within a window; pairs that link are united across passes. Passes
follow the label's size: as many as it takes until a pair at the threshold has stood in a common window but for a chance of
`missed`. A label that a window holds whole needs one, in which all its pairs meet.

The passes find components, which are small. Within each component every two vectors are then compared, so that a vector's
number of links is exact whatever the windows saw, also in a family of near vectors far larger than any window: such a
family is compared block by block, and runs of it are skipped if the balls around them show that none can link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate
from math import acos, ceil, log, log1p, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, bounded

#: Vectors of a label or component that are one window, and that one task compares as a whole, neighbours after each vector in a pass, vectors of a block, signs of a key.
FULL, WINDOW, BLOCK, SIGNS = 1024, 512, 4096, 60
#: Chance that a pair at the threshold meets in no pass.
MISSED = 1e-3
_FOUND = "rep long, links long, to long"
_KEYED = "rep long, grp long, copies long, count long, unit binary, keys array<long>"


def passes(count: int, window: int, least: float, missed: float) -> int:
    """Passes over `count` vectors until a pair of cosine `least` has stood within `window` places, but for a chance of `missed`.

    Two such vectors agree in a sign with a chance of 1 - angle / pi. They share a window if they agree in the signs that
    divide the vectors into parts of that size; one more stands for windows and partitions that end between them.
    """
    agree = 1 - acos(max(-1.0, min(1.0, least))) / pi
    met = min(agree ** (1 + max(0.0, log2(count / window))), 1 - 1e-6)
    return max(1, ceil(log(missed) / log1p(-met)))


def _digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the length and a digest of each usable vector; both are null for the others."""
    for batch in batches:
        sizes, digests = [], []
        for label, vector in zip(batch["label"].to_pylist(), batch["vector"].to_pylist(), strict=True):
            good = label is not None and vector is not None and len(vector) > 0 and None not in vector
            array = np.array(vector if good else [], np.float64) + 0.0
            good = good and bool(np.isfinite(array).all()) and bool(array.any())
            sizes.append(len(array) if good else None)
            digests.append(hashlib.blake2b(array.tobytes(), digest_size=16).digest() if good else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())], [*batch.schema.names, "size", "cls"])


def _keying(full: int, window: int, least: float, missed: float, signs: int, seed: int = 11):
    """Each vector at length one as bytes, and its keys: as many as its label has passes, one at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = np.int64(1) << np.arange(signs - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            sizes, counts = (batch[x].to_numpy(zero_copy_only=False) for x in ("size", "count"))
            turns = np.array([passes(int(c), window, least, missed) if c > full else 1 for c in counts], np.int64)
            units: list[bytes] = [b""] * batch.num_rows
            keys: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                most = int(turns[rows].max())
                if size not in planes or planes[size].shape[1] < most * signs:  # a pass has the same planes in every batch
                    planes[size] = np.concatenate([np.random.default_rng([seed, int(size), k]).standard_normal((int(size), signs)) for k in range(most)], 1)
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    vectors = np.array(batch["vector"].take(pa.array(part)).to_pylist(), np.float64)
                    # scaled first, so that no product over- or underflows
                    vectors /= np.abs(vectors).max(1, keepdims=True)
                    vectors /= np.sqrt((vectors * vectors).sum(1, keepdims=True))
                    own = ((vectors @ planes[size][:, : int(turns[part].max()) * signs] > 0).reshape(len(part), -1, signs) * weight).sum(2)
                    for i, unit, key in zip(part.tolist(), vectors, own, strict=True):
                        units[i], keys[i] = unit.tobytes(), key[: turns[i]]
            ends = np.concatenate([[0], np.cumsum(turns)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in ("rep", "grp", "copies", "count")), pa.array(units, pa.binary()), listed], ["rep", "grp", "copies", "count", "unit", "keys"])

    return run


def _vectors(units: pa.Array | list) -> np.ndarray:
    held = units.to_pylist() if isinstance(units, pa.Array) else units
    return np.frombuffer(b"".join(held), np.float64).reshape(len(held), -1)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of rows with equal values in all columns."""
    n = len(columns[0])
    edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], 0)) + 1 if n else []
    return list(zip([0, *edges], [*edges, n], strict=True)) if n else []


def _passing(window: int, least: float):
    """Edges of a forest of the pairs that link within `window` places of the sorted rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            grp, turn, rep = (batch[x].to_numpy() for x in ("grp", "pass", "rep"))
            out = []
            for lo, hi in _runs(grp, turn):
                vectors, reps, seen = _vectors(batch["unit"].slice(lo, hi - lo)), rep[lo:hi], 0
                if last and last[0] == (grp[lo], turn[lo]):
                    seen = len(last[1])
                    reps, vectors = np.concatenate([last[1], reps]), np.concatenate([last[2], vectors])
                rows, cols = [], []
                for a in range(0, len(reps), window):
                    i, j = np.nonzero(vectors[a : a + window] @ vectors[a : a + 2 * window].T >= least)
                    good = (j > i) & (j - i <= window) & (a + j >= seen)
                    rows.append(a + i[good])
                    cols.append(a + j[good])
                root = _forest(np.concatenate(rows), np.concatenate(cols), len(reps))
                linked = root != np.arange(len(reps))
                out.append((reps[linked], reps[root[linked]]))
                last = (grp[lo], turn[lo]), reps[-window:].copy(), vectors[-window:].copy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out] + [np.zeros(0, np.int64)])) for k in (0, 1)], ["rep", "to"])

    return run


def _within(least: float):
    """Links and a forest of every cell, whose rows stand together in a partition: each pair of a cell is compared."""

    def whole(reps: np.ndarray, copies: np.ndarray, units: list[bytes]) -> tuple[np.ndarray, ...]:
        near = np.triu((v := _vectors(units)) @ v.T >= least, 1)
        links = near @ copies.astype(np.float64) + copies.astype(np.float64) @ near
        root = _forest(*np.nonzero(near), len(reps))
        out = (links > 0) | (root != np.arange(len(reps)))
        return reps[out], links[out].astype(np.int64), reps[root[out]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: int | None = None
        held: tuple[list, list, list] = ([], [], [])
        none = np.zeros(0, np.int64)
        flush = lambda parts: pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in parts] + [none])) for k in range(3)], ["rep", "links", "to"])
        for batch in batches:
            cells, rep, copies, out = batch["cell"].to_numpy(), batch["rep"].to_numpy(), batch["copies"].to_numpy(), []
            for lo, hi in _runs(cells):
                if cells[lo] != cell:
                    if len(held[2]) > 1:
                        out.append(whole(np.concatenate(held[0]), np.concatenate(held[1]), held[2]))
                    cell, held = cells[lo], ([], [], [])
                held[0].append(rep[lo:hi])
                held[1].append(copies[lo:hi])
                held[2].extend(batch["unit"].slice(lo, hi - lo).to_pylist())
            yield flush(out)
        if len(held[2]) > 1:
            yield flush([whole(np.concatenate(held[0]), np.concatenate(held[1]), held[2])])

    return run


def _numbering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*(batch[x] for x in ("rep", "cell", "copies", "unit")), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], ["rep", "cell", "copies", "unit", "part", "at"])
        at += n


def _forest(rows: np.ndarray, cols: np.ndarray, count: int) -> np.ndarray:
    """The least index that each index reaches by the links."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[rows], root[cols])
        new = root.copy()
        np.minimum.at(new, root[rows], low)
        np.minimum.at(new, root[cols], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            return root
        root = new


def _balls(vectors: np.ndarray, first: int, window: int) -> list[tuple[int, np.ndarray, np.ndarray, float]]:
    """(first index, vectors, centre, greatest angle to it) of each run of `window` vectors."""
    out = []
    for a in range(0, len(vectors), window):
        own = vectors[a : a + window]
        centre = own.sum(0)
        norm = np.sqrt(centre @ centre)
        angle = float(np.arccos(np.clip((own @ (centre / norm)).min(), -1, 1))) if norm > 1e-6 else np.pi
        out.append((first + a, own, centre / max(norm, 1e-6), angle))
    return out


def _comparing(window: int, least: float):
    reach = float(np.arccos(np.clip(least, -1, 1))) + 1e-6  # more than any rounding of an angle

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("rank")
        cell, rep, copies = tile["cell"].to_numpy(), tile["rep"].to_numpy(), tile["copies"].to_numpy()
        one, two = tile["one"].iloc[0], tile["two"].iloc[0]
        middle = len(tile) if one == two else int((tile["block"] == one).sum())
        links, root = np.zeros(len(tile), np.int64), np.arange(len(tile))
        for lo, hi in _runs(cell):
            if one != two and not lo < middle < hi:
                continue
            vectors = _vectors(tile["unit"].iloc[lo:hi].tolist())
            left = _balls(vectors[: middle - lo], lo, window)
            right = left if one == two else _balls(vectors[middle - lo :], middle, window)
            for k, (a, these, centre, angle) in enumerate(left):
                for b, those, other, wide in right[k if one == two else 0 :]:
                    if np.arccos(np.clip(centre @ other, -1, 1)) > angle + wide + reach:
                        continue
                    near = these @ those.T >= least
                    if a == b:
                        near = np.triu(near, 1)
                    if not near.any():
                        continue
                    links[a : a + len(these)] += (near @ copies[b : b + len(those)].astype(np.float64)).astype(np.int64)
                    links[b : b + len(those)] += (copies[a : a + len(these)].astype(np.float64) @ near).astype(np.int64)
                    i, j = np.nonzero(near)
                    i, j = root[a + i], root[b + j]
                    if (apart := i != j).any():
                        root = _forest(i[apart], j[apart], len(tile))[root]
        out = (links > 0) | (root != np.arange(len(tile)))
        return pd.DataFrame({"rep": rep[out], "links": links[out], "to": rep[root[out]]})

    return run


def _by_blocks(cells: DataFrame, scratch: Scratch, least: float, window: int, block: int) -> DataFrame:
    """Links and a forest of cells of any size: every two blocks that hold rows of one cell are a task.

    Rows are ordered by cell and key, so that like vectors stand together; the order decides cost, never results.
    """
    order = ["cell", "key", "rep"]
    placed = scratch.keep(cells.repartitionByRange(*order).sortWithinPartitions(*order).select("rep", "cell", "copies", "unit").mapInArrow(_numbering, "rep long, cell long, copies long, unit binary, part int, at long"))
    ends = sorted(placed.groupBy("part").agg((F.max("at") + 1).alias("n")).collect())  # one row for each partition
    base = list(zip((p for p, _ in ends), accumulate((n for _, n in ends), initial=0), strict=False))
    dealt = placed.join(F.broadcast(cells.sparkSession.createDataFrame(base, "part int, base long")), "part")
    rank = F.col("base") + F.col("at")
    dealt = dealt.select("rep", "cell", "copies", "unit", rank.alias("rank"), F.floor(rank / block).cast("long").alias("block"))
    spans = dealt.groupBy("cell").agg(F.min("block").alias("low"), F.max("block").alias("high"))  # large cells only: few
    met = dealt.join(spans, "cell").withColumn("with", F.explode(F.sequence("low", "high")))
    met = met.select("rep", "cell", "copies", "unit", "rank", "block", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"))
    return met.groupBy("one", "two").applyInPandas(_comparing(window, least), _FOUND)


def near_vectors(
    vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = 0.93, full: int = FULL, window: int = WINDOW, block: int = BLOCK, missed: float = MISSED,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row; other columns are not read.

    Vectors of one label link by a cosine of at least `least`, in double precision; equal vectors always link, and finite ones
    of any magnitude may. A label of up to `full` distinct vectors is a window as a whole, in which every pair meets. In a larger one a pair at the
    threshold stays unseen with a chance of `missed` at most (nearer ones with less); what a component holds is counted in
    full. Vectors of other lengths, and vectors that are null, empty or zero, that hold a null or a value that is not finite,
    or whose label is null link with nothing and are their own component. Rows that share an id are one vector for components.
    Rows without an id link with nothing, have no component and are not kept. No rows: no rows.

    A vector moves once for each pass and once for its component; a component of more than `full` vectors is compared in
    tasks of two blocks, so that a vector goes to as many tasks as its component has blocks.
    """
    rows = bounded(vectors).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("label", F.when(F.col("vec_id").isNotNull(), F.col("label")))
    held = scratch.keep(rows.mapInArrow(_digesting, "vec_id long, label string, vector array<double>, size int, cls binary"))
    total = held.count()
    good = held.where("cls is not null")
    classes = scratch.keep(good.groupBy("label", "size", "cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), rows=total)
    first = good.join(classes, ["label", "size", "cls"]).where("vec_id = rep").dropDuplicates(["rep", "label", "size", "cls"])
    reps = scratch.keep(first.select("rep", F.xxhash64("label", "size").alias("grp"), "size", "copies", "vector"), rows=total)
    counts = reps.groupBy("grp").agg(F.count("*").alias("count"))
    keyed = reps.join(counts, "grp").select("rep", "grp", "copies", "count", "size", "vector").mapInArrow(_keying(full, window, least, missed, SIGNS), _KEYED)
    keyed = scratch.keep(keyed, reps, total)
    each = keyed.select("rep", "grp", "count", "unit", F.posexplode("keys").alias("pass", "key"))
    order, row = ["grp", "pass", "key", "rep"], ["rep", "grp", "pass", "unit"]
    small, large = each.where(F.col("count") <= full), each.where(F.col("count") > full)
    passed = "rep long, to long"
    edges = small.repartition("grp").sortWithinPartitions(*order).select(*row).mapInArrow(_passing(full, least), passed)  # labels stay whole
    edges = edges.union(large.repartitionByRange(*order).sortWithinPartitions(*order).select(*row).mapInArrow(_passing(window, least), passed))
    edges = scratch.keep(edges.distinct())
    united = scratch.keep(components(edges, scratch), edges, total)
    members = united.union(united.select("component", "component").distinct()).select(F.col("node").alias("rep"), "component")
    # an id may stand for vectors of several labels, which are united by it but not compared
    cells = keyed.drop("count").join(members, "rep").select("rep", F.xxhash64("component", "grp").alias("cell"), "copies", "unit", F.col("keys")[0].alias("key"))
    cells = scratch.keep(cells, keyed, total)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("count")).where("count > 1")
    cells = cells.join(sizes, "cell")
    less = cells.where(F.col("count") <= full).select("rep", "cell", "copies", "unit").repartition("cell").sortWithinPartitions("cell", "rep").mapInArrow(_within(least), _FOUND)
    found = less.unionByName(_by_blocks(cells.where(F.col("count") > full).drop("count"), scratch, least, window, block))
    found = scratch.keep(found, rows=total)
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = components(found.select("rep", "to"), scratch, total)
    ids = classes.join(sums, "rep", "left").join(reached, F.col("rep") == F.col("node"), "left")
    ids = scratch.keep(ids.select("label", "size", "cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("least")), rows=total)
    out = held.select("vec_id", "label", "size", "cls").join(ids, ["label", "size", "cls"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
