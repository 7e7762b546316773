"""Repeated spans of words, by compacting a De Bruijn graph of word k-mers.

Windows of `k` words are the graph's edges. To find those that several documents hold without dealing out
every window, each window is named by its least hash of `m` words (equal windows have equal names): names
that one text alone holds are dropped, and only windows with another name are dealt out. A window that
occurs in two documents becomes a row with its first document and its neighbours; where a window's only
follower has it as only forerunner, both occur in the same places, so paths compact and only the two ends of a
path return to each document that holds it. There they mark the span that a smaller id also has, with its source:
that document and the place of the path in it. The words at the source are digested, and a span is cut only where
its own words have the same digest; window hashes alone cut nothing.

Whole documents that repeat another's words (by a digest of all of them) are set aside first; they are removed as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import Scratch, bounded, fresh, gathered, size

#: Words of a window, and of the pieces that name one.
WINDOW, PIECE = 13, 5
#: So many rows of a narrow table weigh as much as a row with a text or its names.
WIDE = 4
_NAMES = "ord long, tkey long, cls binary, cls8 long, names array<long>"
_RUNS = "ord long, tkey long, start int, keys array<long>, checks array<int>"
_OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, text string"


def _windows(texts: list[bytes | None], k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and name of the window that starts at each word of the texts, whether it lies in one text, each text's first word."""
    hashes, at = words.hashed(texts)
    names = words.rolled(hashes, m, 2)
    count = max(len(hashes) - k + 1, 0)
    name = names[:count].copy()
    for step in range(1, k - m + 1):
        np.minimum(name, names[step : step + count], out=name)
    inside = np.zeros(count, bool)
    for a, b in zip(at[:-1], at[1:], strict=True):
        inside[a : max(a, b - k + 1)] = True
    return hashes, name, inside, at


def _class(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _longs(parts: list[np.ndarray], kind: type = np.int64) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(kind)))


def _naming(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for a, b in words.chunks(texts):
                hashes, name, inside, at = _windows(texts.slice(a, b - a).to_pylist(), k, m)
                name = name.view(np.int64)
                cls, lists = [], []
                for x, y in zip(at[:-1], at[1:], strict=True):
                    cls.append(_class(hashes[x:y]))
                    own = name[x : max(x, y - k + 1)]
                    lists.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
                first = np.frombuffer(b"".join(cls), np.int64)[::2]
                yield pa.RecordBatch.from_arrays([batch["ord"].slice(a, b - a), batch["tkey"].slice(a, b - a), pa.array(cls, pa.binary()), pa.array(first.copy()), _longs(lists)], ["ord", "tkey", "cls", "cls8", "names"])

    return run


def _running(k: int, m: int):
    """Runs of windows with names that several texts hold; each run with the windows before and after it (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for a, b in words.chunks(texts):
                hashes, name, _, at = _windows(texts.slice(a, b - a).to_pylist(), k, m)
                held = batch["names"].slice(a, b - a)
                ends, flat = held.offsets.to_numpy(), held.values.to_numpy(zero_copy_only=False)
                name = name.view(np.int64)
                rows: list[tuple] = []
                for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if y - x < k:
                        continue
                    own = name[x : y - k + 1]
                    shared = np.isin(own, flat[ends[i] : ends[i + 1]])
                    if not shared.any():
                        continue
                    keys = np.concatenate([[0], words.rolled(hashes[x:y], k, 3).view(np.int64), [0]])
                    checks = np.concatenate([[0], words.rolled(hashes[x:y], k, 4).view(np.int64) >> 32, [0]]).astype(np.int32)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], shared.view(np.int8), [0]])))
                    for s, e in zip(edge[::2], edge[1::2], strict=True):
                        rows.append((a + i, s, keys[s : e + 2], checks[s : e + 2]))
                at_row = pa.array(np.array([r[0] for r in rows], np.int64))
                yield pa.RecordBatch.from_arrays([
                    batch["ord"].take(at_row), batch["tkey"].take(at_row), pa.array(np.array([r[1] for r in rows], np.int32)),
                    _longs([r[2] for r in rows]), _longs([r[3] for r in rows], np.int32),
                ], ["ord", "tkey", "start", "keys", "checks"])

    return run


def _digest(words_: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words_), digest_size=16).digest()


def _attesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the words at each source that a text is asked for."""
    for batch in batches:
        keys, checks, digests = [], [], []
        for text, asks in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["asks"].to_pylist(), strict=True):
            own = (text or b"").split()
            for ask in asks:
                keys.append(ask["key"])
                checks.append(ask["check"])
                digests.append(_digest(own[ask["at"] : ask["at"] + ask["length"]]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(checks, pa.int32()), pa.array(digests, pa.binary())], ["key", "check", "digest"])


def _cutting(k: int):
    """Removes the words that the spans cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for a, b in words.chunks(texts, 1 << 20):
                part = batch.slice(a, b - a)
                total, gone, spans, kept = [], [], [], []
                for text, found, copy in zip(texts.slice(a, b - a).to_pylist(), part["spans"].to_pylist(), part["copy"].to_pylist(), strict=True):
                    own = (text or b"").split()
                    total.append(len(own))
                    cover = _cover(own, found, bool(copy), k)
                    spans.append([{"start": s, "end": e} for s, e in cover])
                    gone.append(sum(e - s for s, e in cover))
                    kept.append(b" ".join(_rest(own, cover)))
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()).cast(pa.string()),
                ], ["doc_id", "n_words", "n_removed", "spans", "text"])

    return run


def _rest(own: list[bytes], cover: list[tuple[int, int]]) -> list[bytes]:
    at, rest = 0, []
    for s, e in [*cover, (len(own), len(own))]:
        rest += own[at:s]
        at = e
    return rest


def _cover(own: list[bytes], spans: list[dict] | None, copy: bool, k: int) -> list[tuple[int, int]]:
    """Disjoint word ranges that the spans with their source's words cover, or all of a copy."""
    if copy and len(own) >= k:
        return [(0, len(own))]
    out: list[tuple[int, int]] = []
    for s, e, digest in sorted((x["start"], x["end"], x["digest"]) for x in spans or []):
        if _digest(own[s:e]) != digest:
            continue
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ord: the id, or above all ids where it is null; tkey tells rows apart that share an id."""
    return bounded(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("ord"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).cast("string").alias("text")
    )


def repeated_windows(runs: DataFrame) -> DataFrame:
    """The runs' windows that more than one document holds: key, check, first document, neighbours where they are unique."""
    at = F.posexplode(F.slice("keys", 2, F.size("keys") - 2))
    each = runs.select("ord", "keys", "checks", at.alias("i", "key")).select(
        "ord", "key", F.expr("checks[i + 1]").alias("check"), F.expr("keys[i]").alias("before"), F.expr("keys[i + 2]").alias("after")
    )
    sums = each.groupBy("key", "check").agg(*(f(c).alias(f"{n}_{c}") for c in ("ord", "before", "after") for n, f in (("least", F.min), ("most", F.max))))
    only = lambda c: F.when(F.col(f"least_{c}") == F.col(f"most_{c}"), F.col(f"least_{c}")).alias(c)
    return sums.where("least_ord < most_ord").select("key", "check", F.col("least_ord").alias("owner"), only("before"), only("after"))


def path_ends(windows: DataFrame) -> DataFrame:
    """The windows at which a nonbranching path starts (head) or ends (tail); the others lie within one."""
    own = F.col("w.key")
    back = windows.select(F.col("key").alias("from"), F.col("after").alias("leads")).where("leads is not null")
    forth = windows.select(F.col("key").alias("to"), F.col("before").alias("comes")).where("comes is not null")
    joined = windows.alias("w").join(back, (F.col("w.before") == F.col("from")) & (F.col("leads") == own), "left")
    joined = joined.join(forth, (F.col("w.after") == F.col("to")) & (F.col("comes") == own), "left")
    ends = joined.select("w.key", "w.check", "w.owner", F.col("from").isNull().alias("head"), F.col("to").isNull().alias("tail"))
    return ends.where("head or tail")


def _marks(rows: DataFrame, scratch: Scratch, k: int, m: int) -> DataFrame:
    """(ord, tkey, copy, spans) of the rows that lose words: whole copies, and repeated paths with the digest of their source."""
    named = scratch.keep(rows.select("ord", "tkey", "text").mapInArrow(_naming(k, m), _NAMES))
    count = named.count()
    first = scratch.keep(named.groupBy("cls").agg(F.min("ord").alias("least")), rows=count)
    copies = named.join(first, "cls").where("ord > least").select("ord", "tkey", F.lit(True).alias("copy")).distinct()
    copies = scratch.keep(copies, rows=count)
    each = named.select("ord", "tkey", "cls8", F.explode("names").alias("name"))
    shared = scratch.keep(each.groupBy("name").agg(F.min("cls8").alias("a"), F.max("cls8").alias("b")).where("a != b").select("name"))
    own = each.select("ord", "tkey", "name").join(shared, "name").join(copies, ["ord", "tkey"], "left_anti")
    own = scratch.keep(own.groupBy("ord", "tkey").agg(F.collect_set("name").alias("names")), shared, WIDE * count)
    scratch.drop(named, first)
    runs = scratch.keep(rows.join(own, ["ord", "tkey"]).select("ord", "tkey", "text", "names").mapInArrow(_running(k, m), _RUNS), own, WIDE * count)
    windows = scratch.keep(repeated_windows(runs))
    ends = scratch.keep(path_ends(windows), windows)
    at = F.posexplode(F.slice("keys", 2, F.size("keys") - 2))
    places = runs.select("ord", "tkey", "start", "checks", at.alias("i", "key")).select("ord", "tkey", "key", F.expr("checks[i + 1]").alias("check"), (F.col("start") + F.col("i")).alias("at"))
    placed = scratch.keep(places.join(ends, ["key", "check"]).where("ord > owner or head"), ends, WIDE * count)
    scratch.drop(runs)
    spans = scratch.keep(_spans(placed, k), rows=WIDE * count)
    first = placed.where("head and ord = owner").groupBy("key", "check").agg(F.min(F.struct("ord", "tkey", "at")).alias("src"))
    length = spans.groupBy("key", "check").agg(F.max(F.col("end") - F.col("start")).alias("length"))
    asks = first.join(length, ["key", "check"]).groupBy("src.ord", "src.tkey").agg(F.collect_list(F.struct("key", "check", "src.at", "length")).alias("asks"))
    asks = scratch.keep(asks, placed, count)
    sources = rows.join(asks, ["ord", "tkey"]).select("text", "asks").mapInArrow(_attesting, "key long, check int, digest binary")
    sources = scratch.keep(sources.distinct(), asks, WIDE * count)
    marks = spans.join(sources, ["key", "check"]).groupBy("ord", "tkey").agg(F.collect_list(F.struct("start", "end", "digest")).alias("spans"))
    marks = scratch.keep(marks.join(copies, ["ord", "tkey"], "full"), spans, WIDE * count)
    scratch.drop(sources, copies)
    return marks


def _spans(placed: DataFrame, k: int) -> DataFrame:
    """(ord, tkey, start, end, key, check): word ranges from each head of a path to its tail, in texts after the path's first."""
    ends = placed.where("ord > owner").groupBy("ord", "tkey").agg(
        F.sort_array(F.collect_set(F.when(F.col("head"), F.struct("at", "key", "check")))).alias("heads"), F.sort_array(F.collect_set(F.when(F.col("tail"), F.col("at")))).alias("tails")
    )
    zipped = F.when(F.size("heads") == F.size("tails"), F.arrays_zip("heads", "tails")).otherwise(F.raise_error(F.lit("a path without an end")))
    each = ends.select("ord", "tkey", F.explode(zipped).alias("x"))
    return each.select("ord", "tkey", F.col("x.heads.at").alias("start"), (F.col("x.tails") + k).alias("end"), "x.heads.key", "x.heads.check")


def substring_dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = PIECE) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, text), one row per input row; other columns are not read.

    A word goes if a window of k words covers it that also starts in a document with a smaller id; the text
    that stays has its words joined by one space. Windows are judged on the input. A null text has no words.
    Texts of fewer than k words stay whole. A null id counts as greater than all ids, and null ids remove
    nothing from each other; nor do rows that share an id. No rows: no rows.
    """
    rows = _read(docs, id_col, text_col)
    marks = _marks(rows, scratch, k, m)
    return gathered(rows.join(marks, ["ord", "tkey"], "left").select("doc_id", "text", "spans", "copy"), size(docs)).mapInArrow(_cutting(k), _OUT)


def cut_spans(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = PIECE) -> DataFrame:
    """The input's columns with the repeated passages cut out of the texts.

    A text from which nothing goes stays as it is, character for character; of the others the words that stay
    are joined by one space. Rows of which no word is left go, those without a word from the start do not.
    """
    return _cut(docs, _marks(_read(docs, id_col, text_col), scratch, k, m), id_col, text_col, k)


def _cut(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    names = docs.columns
    extra = {x: fresh(f"{x}__", docs) for x in ("ord", "tkey", "spans", "copy")}
    rows = docs.withColumns({extra["ord"]: F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), extra["tkey"]: F.xxhash64(text_col)})
    rows = rows.join(marks.select(*(F.col(a).alias(b) for a, b in extra.items())), [extra["ord"], extra["tkey"]], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[text_col].to_pylist()
            keep = [True] * len(texts)
            marked = zip(batch[extra["spans"]].to_pylist(), batch[extra["copy"]].to_pylist(), strict=True)
            for i, (spans, copy) in enumerate(marked):
                if not spans and not copy:
                    continue
                own = (texts[i] or "").encode().split()
                cover = _cover(own, spans, bool(copy), k)
                if cover:
                    rest = _rest(own, cover)
                    texts[i], keep[i] = b" ".join(rest).decode(), bool(rest)
            columns = [pa.array(texts, pa.string()) if x == text_col else batch[x] for x in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return gathered(rows, size(docs)).mapInArrow(run, docs.schema)
