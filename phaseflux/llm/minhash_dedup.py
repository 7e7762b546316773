"""Near duplicates of texts: universal-hash minima, banding, verification, components.

Texts with the same set of shingles count as one from the start. Bands of a signature deal the distinct sets
into buckets. First each set is compared with the least and the greatest id of its buckets, which ties the copies
of one text together in linear work. The sets of buckets that then still hold several components are joined without
a loss: ordered from their rarest shingle on, two sets of the wanted similarity must meet within a short prefix of
both, so only sets that share a shingle of their prefixes are paired. Pairs of either kind are screened by their
signatures and then confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import components
from .scratch import ROWS, Scratch, bounded, fresh, gathered, size as bytes_of

#: Bands and minima of a band; at similarity 0.8 a pair shares no bucket with a chance of 4e-7.
BANDS, MINIMA = 28, 4
#: So many rows of a narrow table weigh as much as a row with a whole set.
WIDE = 4
#: Standard errors by which a signature may miss the threshold.
SLACK = 6
#: Bits of the bitmap of wanted ids: so many an id, and at most (4 MiB, whatever the input); false hits cost time, never results.
MARKS_EACH, MARKS = 32, 1 << 25
#: Counters of the sketch that orders shingles from rare to frequent; any order gives the same links.
COUNTERS = 1 << 18
_SETS = "doc_id long, n_shingles long, cls binary, bands array<long>, signature binary"
_PAIR = "a long, b long"
_PREFIX = "token long, r long, component long, n long, place long"


def shingles(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    hashes, at = words.hashed(texts, lower=True)
    rolled = words.rolled(hashes, size, 5)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(words.rolled(hashes[a:b], int(b - a), 6 + int(b - a)))
        else:
            out.append(rolled[:0])
    return out


class Minima:
    """Minima of multiply-add-shift hashes over a set, 32 bits each."""

    def __init__(self, count: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.by = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2)

    def __call__(self, items: np.ndarray) -> np.ndarray:
        least = np.full(len(self.by), np.iinfo(np.uint64).max)
        for at in range(0, len(items), 1024):
            np.minimum(least, (items[at : at + 1024, None] * self.by + self.plus).min(0), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)


def _signing(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(bands * rows)
        turn = np.random.default_rng(8).integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for a, b in words.chunks(texts):
                sets = shingles(texts.slice(a, b - a).to_pylist(), size)
                signs = [minima(x) if len(x) else None for x in sets]
                keys = [None if x is None else words.mix((x.reshape(bands, rows) * turn).sum(1, dtype=np.uint64)).view(np.int64) for x in signs]
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array([None if x is None else (x & 0xFFFF).astype("<u2").tobytes() for x in signs], pa.binary()),
                ], ["doc_id", "n_shingles", "cls", "bands", "signature"])

    return run


def _screening(threshold: float, count: int):
    least = max(1, int(count * threshold - SLACK * (count * threshold * (1 - threshold)) ** 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch[x].to_pylist()), "<u2").reshape(-1, count) for x in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((one == two).sum(1) >= least))

    return run


def _mark(ids: pa.Array, marks: int) -> np.ndarray:
    return (words.mix(np.asarray(ids, np.int64).view(np.uint64)) % np.uint64(marks)).astype(np.int64)


def _marking(marks: int):
    """The words of a bitmap that a task's ids touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(marks // 8, np.uint8)
        for batch in batches:
            at = _mark(batch["doc_id"], marks)
            np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
        seen = seen.view("<i8")
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["word", "bits"])

    return run


def _setting(size: int, seen: np.ndarray):
    """The sets of the texts whose ids the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _mark(batch["doc_id"], len(seen) * 8)
            batch = batch.filter(pa.array((seen[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            texts = batch["text"].cast(pa.binary())
            for a, b in words.chunks(texts):
                sets = shingles(texts.slice(a, b - a).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "items"])

    return run


def _counting(counters: int):
    """How often the shingles of a task's sets fall on each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.int64)
        for batch in batches:
            for x in batch["items"]:
                np.add.at(counts, _counter(np.frombuffer(x.as_buffer(), np.uint64), counters), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["counter", "n"])

    return run


def _counter(items: np.ndarray, counters: int) -> np.ndarray:
    return (items & np.uint64(counters - 1)).astype(np.int64)


def _prefixes(counts: np.ndarray, percent: int):
    """The rarest shingles of each set, as many as a similar set may lack and one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, tokens, sizes = batch.slice(at, 256), [], []
                for x in part["items"]:
                    items = np.frombuffer(x.as_buffer(), np.uint64)
                    order = np.lexsort((items, counts[_counter(items, len(counts))]))
                    tokens.append(items[order[: len(items) + 1 - -(-percent * len(items) // 100)]])
                    sizes.append(len(items))
                many = np.array([len(x) for x in tokens], np.int64)
                place = np.concatenate([np.arange(x) for x in many])
                spread = lambda x: pa.array(np.repeat(np.asarray(x), many))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), spread(part["doc_id"]), spread(part["component"]), spread(sizes), pa.array(place)], ["token", "r", "component", "n", "place"]
                )

    return run


def _meeting(sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Distinct pairs of sets of different components that meet within their prefixes; every link between components is one of them.

    With sizes x <= y a link has at least t = percent * (x + y) / (100 + percent) common shingles, so the first of them,
    in the common order, has t - 1 behind it in both sets.
    """
    sketch = sets.select("items").mapInArrow(_counting(COUNTERS), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    counts = np.zeros(COUNTERS, np.int32)
    counts[sketch["counter"].to_numpy()] = np.minimum(sketch["n"].to_numpy(), np.iinfo(np.int32).max)
    heads = scratch.keep(sets.select("doc_id", "component", "items").mapInArrow(_prefixes(counts, percent), _PREFIX))
    # a shingle of one component only, as a family of versions has many of, pairs nothing
    shared = heads.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select(F.expr("token ^ 0L AS token"))
    heads = scratch.keep(heads.join(shared, "token"), heads)
    of = lambda x: heads.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("r", "component", "n", "place")))
    least = lambda total: f"(({percent} * ({total}) + {99 + percent}) div {100 + percent})"
    small, large = of("a").where(f"place_a + {least('2 * n_a')} <= n_a"), of("b")
    common = least("n_a + n_b")
    fit = f"(n_a < n_b or n_a = n_b and r_a < r_b) and component_a != component_b and 100 * n_a >= {percent} * n_b and place_a + {common} <= n_a and place_b + {common} <= n_b"
    pairs = small.join(large, "token").where(fit).select(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b")).distinct()
    return scratch.keep(pairs)


def _confirming(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch["xa"], batch["xb"], strict=True)):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if min(len(one), len(two)) * 100 < percent * max(len(one), len(two)):
                    continue
                at = np.searchsorted(one, two)
                both = int((one[np.minimum(at, len(one) - 1)] == two).sum())
                good[i] = 100 * both >= percent * (len(one) + len(two) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _alike(pairs: DataFrame, reps: DataFrame, scratch: Scratch, percent: int, count: int, rows: int | None = None) -> DataFrame:
    """Of distinct pairs of ids, those whose signatures are similar enough."""
    sign = lambda x: reps.select(F.col("rep").alias(x), F.col("signature").alias(f"s{x}"))
    return scratch.keep(pairs.join(sign("a"), "a").join(sign("b"), "b").mapInArrow(_screening(percent / 100, count), _PAIR).distinct(), rows=rows)


def _sets(texts: DataFrame, wanted: DataFrame, scratch: Scratch, size: int, rows: int, marks: int = MARKS) -> DataFrame:
    """(doc_id, items): the sets of the wanted ids, a kept table of one column without nulls.

    A bitmap of fixed size holds most other texts back where they are read, so that the shuffle carries the wanted
    sets, not every text. The semi join takes out what the bitmap lets through by chance.
    """
    marks = min(marks, max(64, 1 << (MARKS_EACH * wanted.count()).bit_length()))
    touched = wanted.mapInArrow(_marking(marks), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # marks / 64 rows at most
    seen = np.zeros(marks // 64, "<i8")
    seen[touched["word"].to_numpy()] = touched["bits"].to_numpy()
    sets = texts.where("doc_id is not null").mapInArrow(_setting(size, seen.view(np.uint8)), "doc_id long, items binary")
    return scratch.keep(sets.join(wanted, "doc_id", "left_semi").distinct(), rows=WIDE * rows)


def _confirmed(pairs: DataFrame, sets: DataFrame, scratch: Scratch, percent: int, rows: int | None = None) -> DataFrame:
    """Of distinct pairs of ids, those whose full sets are similar enough."""
    items = lambda x: sets.select(F.col("doc_id").alias(x), F.col("items").alias(f"x{x}"))
    return scratch.keep(pairs.join(items("a"), "a").join(items("b"), "b").select("a", "b", "xa", "xb").mapInArrow(_confirming(percent), _PAIR), rows=rows)


def near_dedup(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = MINIMA
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row; other columns are not read.

    Words are maximal runs without 0x20 and 0x09-0x0D, A-Z lower-cased; a document's set has its distinct
    shingles of `size` words. Documents link if 100 * common >= percent * united; component_id is the smallest
    id that links reach, and the row of that id is kept. Null, empty and blank texts have no shingles and link
    with nothing. Rows that share an id are one document, in one component. Rows without an id link with
    nothing, have no component and are not marked kept. No rows: no rows.
    """
    texts = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.keep(texts.mapInArrow(_signing(size, bands, rows), _SETS))
    count = signed.count()
    classes = scratch.keep(signed.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("rep")).where("rep is not null"), rows=count)
    reps = scratch.keep(signed.join(classes, "cls").where("doc_id = rep").select("rep", "bands", "signature"), rows=count)
    held = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    # `^ 0` gives the joins exchanges of their own on these sides, so that a hot bucket's rows can be split there
    own = F.expr("key ^ 0L AS key")
    ends = held.groupBy("band", "key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("band", own, "low", "high")
    shared = scratch.keep(held.join(ends, ["band", "key"]), rows=WIDE * count)  # the few rows whose bucket holds another set
    star = shared.select("rep", F.explode(F.array("low", "high")).alias("to")).where("rep != to")
    met = shared.count()
    star = scratch.keep(star.select(F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b")).distinct(), rows=2 * met)
    alike = _alike(star, reps, scratch, percent, bands * rows, 2 * met)
    ends = scratch.keep(alike.select(F.col("a").alias("doc_id")).union(alike.select("b")).distinct(), rows=count)
    sets = _sets(texts, ends, scratch, size, count)
    links = _confirmed(alike, sets, scratch, percent, WIDE * count)
    scratch.drop(alike, sets)
    found = scratch.keep(components(links, scratch, 2 * met), links, count)
    shared = shared.join(found, F.col("rep") == F.col("node"), "left").select("band", "key", "rep", F.coalesce("component", "rep").alias("component"))
    split = shared.groupBy("band", "key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("band", own)
    open_ = scratch.keep(shared.join(split, ["band", "key"]).select(F.col("rep").alias("doc_id"), "component").distinct(), rows=count)
    sets = _sets(texts, scratch.keep(open_.select("doc_id").distinct(), rows=count), scratch, size, count)
    sets = scratch.keep(sets.join(open_, "doc_id"), sets, WIDE * count)
    more = _confirmed(_alike(_meeting(sets, scratch, percent), reps, scratch, percent, bands * rows), sets, scratch, percent)
    found = scratch.keep(components(found.union(more), scratch), found, count)
    scratch.drop(sets)
    ids = classes.join(found, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("reached"))
    ids = scratch.keep(ids, rows=count)
    out = signed.select("doc_id", "n_shingles", "cls").join(ids, "cls", "left").coalesce(max(1, -(-count // ROWS)))
    reached = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("reached")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", reached.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_near(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows and columns, one document of each component; rows without an id stay."""
    gone, key = fresh("gone__", docs), fresh("id__", docs)
    drop = near_dedup(docs, scratch, id_col, text_col, size, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias(gone)).distinct()
    return gathered(docs.withColumn(key, F.col(id_col).cast("long")).join(drop, F.col(key) == F.col(gone), "left_anti").select(*docs.columns), bytes_of(docs))
