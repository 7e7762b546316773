"""Exact duplicates, by a minimal perfect hash over the digests that a history holds.

The history's distinct digests are dealt into shards by their first bytes. Each shard becomes one row: the
displacements of a minimal perfect hash, and the slots it addresses, each with a full digest, the winner's
id and the number of copies. A later digest is looked up by hash and compared byte for byte with its slot:
equal, it repeats the history's winner; unequal, it is new, and the new ones group among themselves.
Digests are counted before they are dealt, so a text that makes up a third of all rows is one row there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ROWS, Scratch, bounded, fresh, gathered, size
from .words import mix

#: Digests of a shard, about; a shard is a row of some 6 MB at most.
SHARD = 50_000
#: Keys of a displacement bucket, on average.
LOAD = 4
INDEX = "shard int, size long, seeds binary, digests binary, winners binary, counts binary"
#: Stands for a null id in the index: greater than any id.
_NONE = (1 << 63) - 1
_GROUP = "digest binary, keep_id long, group_size long"


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(digests).view("<u8").reshape(len(digests), -1)
    return words[:, 1].copy(), words[:, 2].copy()


def _slot(second: np.ndarray, seed: np.ndarray, size: int) -> np.ndarray:
    return mix(second + seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)


def build(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements, and the slot of each of the distinct digests (rows of 32 bytes): a bijection onto 0..n-1.

    Buckets are placed from the largest; each takes the first displacement that sends its keys to free slots.
    """
    size = len(digests)
    first, second = _halves(digests)
    bucket = (first % np.uint64(max(1, size // LOAD))).astype(np.int64)
    seeds = np.zeros(max(1, size // LOAD), np.uint32)
    slots, taken = np.zeros(size, np.int64), np.zeros(size, bool)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(len(seeds) + 1))
    for b in np.argsort(-np.diff(at), kind="stable"):
        own = order[at[b] : at[b + 1]]
        if not len(own):
            break
        base, step = 0, 64
        while True:
            trial = np.arange(base, base + step)
            to = _slot(second[own][None, :], trial[:, None], size).astype(np.int64)
            good = ~taken[to].any(1)
            if len(own) > 1:
                ranked = np.sort(to, 1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
            if good.any():
                break
            base, step = base + step, min(step * 4, 1 << 18)
        k = int(np.argmax(good))
        seeds[b], slots[own], taken[to[k]] = base + k, to[k], True
    return seeds, slots


def locate(index: dict, digests: np.ndarray) -> np.ndarray:
    """Slot of each digest that the shard holds, else -1: the slot's digest is compared byte for byte."""
    size = int(index["size"])
    if not size or not len(digests):
        return np.full(len(digests), -1)
    seeds = np.frombuffer(index["seeds"], np.uint32)
    held = np.frombuffer(index["digests"], np.uint8).reshape(size, 32)
    first, second = _halves(digests)
    slot = _slot(second, seeds[(first % np.uint64(len(seeds))).astype(np.int64)], size).astype(np.int64)
    return np.where((held[slot] == digests).all(1), slot, -1)


def _array(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), 32)


def _index_shard(rows: pd.DataFrame) -> pd.DataFrame:
    digests = _array(rows["digest"])
    seeds, slots = build(digests)
    order = np.argsort(slots)
    one = {"shard": int(rows["shard"].iloc[0]), "size": len(rows), "seeds": seeds.tobytes(), "digests": digests[order].tobytes()}
    one |= {name: rows[of].to_numpy(np.int64)[order].tobytes() for name, of in (("winners", "keep_id"), ("counts", "group_size"))}
    return pd.DataFrame([one])


def _probe_shard(index: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    """All groups of the shard: the history's, counted with their repeats, and the new ones."""
    parts = [probes[["digest", "keep_id", "group_size"]]]
    if len(index):
        one = index.iloc[0]
        at = locate(one, _array(probes["digest"]))
        hit = at >= 0
        counts = np.frombuffer(one["counts"], np.int64).copy()
        counts[at[hit]] += probes["group_size"].to_numpy(np.int64)[hit]
        winners = np.frombuffer(one["winners"], np.int64).copy()
        winners[at[hit]] = np.minimum(winners[at[hit]], probes["keep_id"].to_numpy(np.int64)[hit])
        held = one["digests"]
        parts[0] = parts[0][~hit]
        parts.append(pd.DataFrame({"digest": [held[i : i + 32] for i in range(0, len(held), 32)], "keep_id": winners, "group_size": counts}))
    return pd.concat(parts, ignore_index=True)


def _counted(rows: DataFrame) -> DataFrame:
    """Distinct digests with the least id (_NONE where no row has one) and the number of rows."""
    return rows.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(_NONE)).alias("keep_id"), F.count("*").alias("group_size"))


def _dealt(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with each run of 0x20 and 0x09-0x0D made one space; null counts as empty."""
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(plain, 256)).alias("digest"))


def build_index(history: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The perfect-hash table of a frame of digests() rows, one row for each shard, and the number of shards."""
    groups = scratch.keep(_counted(history))
    shards = max(1, -(-groups.count() // SHARD))
    return scratch.keep(_dealt(groups, shards).groupBy("shard").applyInPandas(_index_shard, INDEX)), shards


def lookup(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, group_size) of every distinct digest of the index and of the new rows."""
    probes = _dealt(_counted(rows), shards)
    found = index.groupBy("shard").cogroup(probes.groupBy("shard")).applyInPandas(_probe_shard, _GROUP)
    return found.withColumn("keep_id", F.nullif(F.col("keep_id"), F.lit(_NONE)))


def groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, DataFrame]:
    """The digests() rows as a table, their number, and (digest, keep_id, group_size) of each distinct digest as a table.

    The lower half of the ids is the history that the perfect hash covers; the other rows, and those
    without an id, are looked up in it.
    """
    rows = scratch.keep(digests(bounded(docs), id_col, text_col))
    cut, count = rows.agg(F.percentile_approx("doc_id", 0.5, 1000), F.count("*")).first()
    old = F.coalesce(F.col("doc_id") <= F.lit(cut).cast("long"), F.lit(False))
    index, shards = build_index(rows.where(old), scratch)
    return rows, count, scratch.keep(lookup(rows.where(~old), index, shards), index, count)


def exact_dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row; other columns are not read.

    Of equal texts the row with the smallest id stays. Null texts count as empty, and equal each other.
    A null id never wins over another; a group that has null ids only has a null keep_id, and its rows
    count as kept. So do all rows that repeat the winner's id and text; keep_exact() leaves one of them.
    No rows: no rows.
    """
    rows, count, found = groups(docs, scratch, id_col, text_col)
    return rows.join(found, "digest").coalesce(max(1, -(-count // ROWS))).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_exact(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without later copies: one row for each distinct normalised text."""
    digest, key, keep = fresh("digest__", docs), fresh("id__", docs), fresh("keep__", docs)
    _, _, found = groups(docs, scratch, id_col, text_col)
    # texts move once: the join and the choice of one row need the same partitioning, in which a hot text spreads by id
    winners = found.select(F.col("digest").alias(f"{digest}w"), F.coalesce("keep_id", F.lit(_NONE)).alias(keep))
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = docs.withColumns({digest: F.unhex(F.sha2(plain, 256)), key: F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE))})
    stay = rows.join(winners, (F.col(digest) == F.col(f"{digest}w")) & (F.col(key) == F.col(keep)), "left_semi")
    return gathered(stay.dropDuplicates([digest, key]).select(*docs.columns), size(docs))
