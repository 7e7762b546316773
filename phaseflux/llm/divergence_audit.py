"""How far the sources of a language differ in their words: divergences of every two sources, and each source's own words.

Counts of (language, source, term) are made once, by one shuffle on language and term. For the pairs, the groups of a
language stand in blocks; the counts of a block are packed by chunks of the vocabulary and replicated to the tasks of its
block-by-block tiles. A task streams over its chunks and keeps one submatrix of pairs and the counts of one chunk, so its memory
depends on neither the vocabulary nor the number of sources. Tiles of large vocabularies are cut into stripes of chunks whose
submatrices are added up. Terms that neither block has cost nothing: they share one value for each pair.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import BATCH, Scratch, held

#: Groups of a block; consecutive rows of counts whose terms are a chunk; terms of a stripe, about.
BLOCK, CHUNK, STRIPE = 64, 1 << 15, 1 << 18
#: Entries that a task counts before it hands them on, and bytes of a text that it splits at once.
ENTRIES, PIECE = 1 << 18, 1 << 20
UNIT = 1_000_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_END = re.compile(rb"[^A-Za-z\x80-\xff]")
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_TILED = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64()), ("seen", pa.int64()), ("rest", pa.int64())])


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes that end between terms."""
    at = 0
    while len(text) - at > PIECE:
        end = _END.search(text, at + PIECE)
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), in parts: a term may come again when ENTRIES were handed on."""
    count: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
    size = 0

    def handed() -> Iterator[pa.RecordBatch]:
        for key, terms in count.items():
            names, within = list(terms), docs[key]
            for at in range(0, len(names), 1 << 14):
                part = names[at : at + (1 << 14)]
                yield pa.record_batch([[key[0]] * len(part), [key[1]] * len(part), part, [terms[t] for t in part], [within[t] for t in part]], schema=_COUNTED)
        count.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(x).to_pylist() for x in ("lang", "source", "text")), strict=True):
            terms, own = count[lang, source], set()
            before = len(terms)
            for piece in _pieces(text):
                found = _TERM.findall(piece.translate(_LOWER))
                terms.update(found)
                own.update(found)
            docs[lang, source].update(own)
            size += len(terms) - before
            if size > ENTRIES:
                yield from handed()
                size = 0
    yield from handed()


def _share(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * top / bottom) for top <= bottom; exact, as no product passes 1000 * bottom."""
    out, left = top // bottom, top % bottom
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // bottom, left % bottom
    return out + 1


def _share_sql(top: str, bottom: str) -> Column:
    """_share() in SQL."""
    out, left = f"(({top}) div ({bottom}))", f"(({top}) % ({bottom}))"
    for _ in range(3):
        out, left = f"({out} * 1000 + ({left} * 1000) div ({bottom}))", f"(({left} * 1000) % ({bottom}))"
    return F.expr(f"1 + {out}")


def _scaled(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Tile:
    """One stripe of the pairs between two blocks of groups (or within one)."""

    def __init__(self, lang: str, i: int, j: int, block: int):
        self.lang, self.i, self.j, self.block, self.seen = lang, i, j, block, 0
        self.bottoms: list[np.ndarray | None] = [None, None]
        self.sums: list[np.ndarray] = []

    def open(self, side: int, bottoms: np.ndarray) -> None:
        self.bottoms[side] = bottoms
        if self.i == self.j:
            self.bottoms[1] = bottoms

    def add(self, parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """A chunk: for each side its groups' places, positions of terms and counts."""
        if not self.sums:
            self.sums = [np.zeros((len(self.bottoms[0]), len(self.bottoms[1])), np.int64) for _ in range(2)]
        terms = np.unique(np.concatenate([x[1] for x in parts.values()]))
        self.seen += len(terms)
        rows = []
        for side in (0, 1):
            count = np.zeros((len(self.bottoms[side]), len(terms)), np.int64)
            part = parts.get(0 if self.i == self.j else side)
            if part:
                count[part[0], np.searchsorted(terms, part[1])] = part[2]
            rows.append(_share(count + 1, self.bottoms[side][:, None]))
        for at, p in enumerate(rows[0]):
            self.sums[0][at] += _scaled(p, rows[1]).sum(axis=1)
            if self.i != self.j:
                self.sums[1][at] += _scaled(rows[1], p).sum(axis=1)

    def result(self) -> Iterator[pa.RecordBatch]:
        """Of each ordered pair: the sum over the terms seen, their number, and the value of each other term."""
        none = [_share(np.ones(len(x), np.int64), np.maximum(x, 1)) for x in self.bottoms]
        sums = self.sums or [np.zeros((len(none[0]), len(none[1])), np.int64)] * 2
        rest = [_scaled(none[0][:, None], none[1]), _scaled(none[1], none[0][:, None])]
        a, b = (x.ravel() for x in np.meshgrid(self.i * self.block + np.arange(len(none[0])), self.j * self.block + np.arange(len(none[1])), indexing="ij"))
        for way, (p, q) in enumerate(((a, b), (b, a))[: 1 if self.i == self.j else 2]):
            part = np.flatnonzero(p != q)
            full = [p, q, sums[way].ravel(), np.full(len(p), self.seen), rest[way].ravel()]
            yield pa.record_batch([pa.array([self.lang] * len(part), pa.string()), *(pa.array(x[part], pa.int64()) for x in full)], schema=_TILED)


def _tiled(block: int):
    """Submatrices of tiles from rows in the order of tile, stripe, chunk; a chunk of -1 opens a side of a tile."""

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, key, chunk, parts = None, None, None, {}
        for batch in batches:
            cells = batch.column("cells")
            flat, at = cells.flatten(), np.concatenate([[0], np.cumsum(np.asarray(cells.value_lengths().fill_null(0)))])
            place, term, count = (np.asarray(flat.field(k)) for k in range(3))
            heads = zip(*(batch.column(x).to_pylist() for x in ("lang", "i", "j", "stripe", "chunk", "side", "bottoms")), strict=True)
            for row, (lang, i, j, stripe, number, side, bottoms) in enumerate(heads):
                if (lang, i, j, stripe) != key:
                    if tile:
                        if parts:
                            tile.add(parts)
                        yield from tile.result()
                    tile, key, chunk, parts = _Tile(lang, i, j, block), (lang, i, j, stripe), -1, {}
                if number < 0:
                    tile.open(side, np.array(bottoms, np.int64))
                    continue
                if number != chunk:
                    if parts:
                        tile.add(parts)
                    chunk, parts = number, {}
                own = slice(at[row], at[row + 1])
                parts[side] = tuple(x[own].copy() for x in (place, term, count))
        if tile:
            if parts:
                tile.add(parts)
            yield from tile.result()

    return tiled


def _counts(plain: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n, all_n (the term's in the language), term_id, first (one row of each term), of the kept terms.

    One shuffle: rows of a term lie together by language and term, which the sums by source and both windows use. Row numbers are
    given after the sort, so a term's rows have consecutive ones and the least names the term.
    """
    counted = plain.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    summed = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    rows = summed.select("*", F.sum("n").over(term).alias("all_n"), F.sum("docs").over(term).alias("all_docs"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("term_id", F.min("row").over(term)).where(F.col("all_docs") >= least)
    return rows.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "all_n", "term_id", (F.col("row") == F.col("term_id")).alias("first"))


def _pairs(counts: DataFrame, groups: DataFrame, block: int, chunk: int, stripe: int) -> DataFrame:
    """lang, a, b (numbers of groups), value of every ordered pair of different groups of a language."""
    number = F.col("at").alias("at"), F.expr(f"at div {block}").alias("block"), F.col("at") % block
    blocks = (
        groups.select("lang", "v", "bottom", *number[:2]).groupBy("lang", "block")
        .agg(F.sort_array(F.collect_list(F.struct("at", "bottom"))).alias("own"), F.max("v").alias("v"))  # at most `block` groups
        .select("lang", "block", F.col("own.bottom").alias("bottoms"), F.expr(f"1 + v div {stripe}").alias("stripes"), F.count("*").over(Window.partitionBy("lang")).alias("blocks"))
    )
    cells = counts.join(groups.select("lang", "source", number[1], number[2].cast("int").alias("place")), ["lang", "source"])
    packed = cells.groupBy("lang", "block", F.expr(f"term_id div {chunk}").alias("chunk")).agg(F.collect_list(F.struct("place", F.expr(f"cast(term_id % {chunk} AS int)").alias("term"), "n")).alias("cells"))
    chunks = packed.join(blocks.drop("bottoms"), ["lang", "block"]).withColumn("stripe", F.expr("pmod(xxhash64(chunk), stripes)")).select("lang", "block", "blocks", "stripe", "chunk", "cells", F.lit(None).cast("array<bigint>").alias("bottoms"))
    opened = blocks.select("lang", "block", "blocks", F.explode(F.expr("sequence(0L, stripes - 1)")).alias("stripe"), F.lit(-1).cast("long").alias("chunk"), F.lit(None).cast("array<struct<place:int,term:int,n:bigint>>").alias("cells"), "bottoms")
    dealt = chunks.union(opened).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "stripe", "chunk", (F.col("block") > F.col("other")).cast("int").alias("side"), "cells", "bottoms")
    tile = ("lang", "i", "j", "stripe")
    tiles = dealt.repartition(*tile).sortWithinPartitions(*tile, "chunk", "side").mapInArrow(_tiled(block), "lang string, a long, b long, value long, seen long, rest long")
    return tiles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("rest").alias("rest"))


def audit(documents: DataFrame, scratch: Scratch, least: int = 3, top: int = 200, block: int = BLOCK, chunk: int = CHUNK, stripe: int = STRIPE) -> DataFrame:
    """lang, source, part, item, value long, rank int: divergences between the sources of each language.

    A term is a run of letters A-Z, a-z or characters from U+0080 on, with A-Z lower-cased. Each language keeps the terms that at
    least `least` of its rows hold; a group is an occurring (lang, source). With V kept terms and N their occurrences in a group
    (or the language), p of a term is 1 + floor(10^9 (count + 1) / (N + V)), and the value of p against q floor((p - q)^2 / q).
    Part `pair` has each other source of the language with the sum over all kept terms; part `term` the group's own terms of
    p above the language's q, up to rank `top`. Ranks go by falling value, then by the item's UTF-8.

    `block` groups, `chunk` rows of counts and about `stripe` terms make a tile, a chunk and a stripe: they decide cost, never results.

    Null languages, sources and texts count as empty; documents without terms still make groups, whose pairs have a value (0 if
    the language keeps no term). Repeated rows count as rows of their own, ids and other columns are not read. An empty table gives no rows.
    """
    spark = documents.sparkSession
    empty = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x)
    plain = documents.select(empty("lang"), empty("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    with held(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH, "spark.sql.parquet.columnarReaderBatchSize": 512}):
        counts = scratch.keep(_counts(plain, least))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = counts.groupBy("lang").agg(F.sum("n").alias("all_total"), F.sum(F.col("first").cast("long")).alias("v"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    named = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", zero("total"), zero("all_total"), zero("v"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = scratch.keep(named.select("*", at.alias("at"), (F.col("total") + F.col("v")).alias("bottom")))

    by = groups.select("lang", "v", F.col("at").alias("a"), "source")
    item = groups.select("lang", F.col("at").alias("b"), F.col("source").alias("item"))
    pair = _pairs(counts, groups, block, chunk, stripe).join(by, ["lang", "a"]).join(item, ["lang", "b"]).select("lang", "source", "item", (F.col("value") + F.col("rest") * (F.col("v") - F.col("seen"))).alias("value"))
    own = counts.join(groups.select("lang", "source", "bottom", F.expr("all_total + v").alias("all_bottom")), ["lang", "source"])
    own = own.select("lang", "source", F.col("term").alias("item"), _share_sql("n + 1", "bottom").alias("p"), _share_sql("all_n + 1", "all_bottom").alias("q")).where("p > q")
    own = own.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = lambda name: ("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return pair.withColumn("rank", rank).select(*columns("pair")).union(own.withColumn("rank", rank).where(F.col("rank") <= top).select(*columns("term")))
