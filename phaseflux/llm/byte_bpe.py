"""Byte-level BPE over whole texts.

Pre-tokens are found without regex: each code point has a class; the pattern is a small automaton over the
classes; its transition functions generate a monoid with a composition table, so the state before every
character of a batch is an associative scan of one-byte elements, done for many columns at a time. Each
distinct slice is merged once and kept; a text's ids are then gathered from the stored ones with numpy.
"""

from __future__ import annotations

import base64
import heapq
import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import bounded

# Classes: letter, number, other, space that starts a pre-token, white space that goes with the run before
# what follows, white space that stands alone, apostrophe of a contraction with one or two letters, end of a text.
_L, _N, _O, _SP, _WS, _W1, _C1, _C2, _END = range(9)
# States before a character: nothing open; in letters, numbers, others, white space; after a starting space;
# with one or two letters of a contraction to come.
_NONE, _IN_L, _IN_N, _IN_O, _IN_W, _AFTER, _ONE, _TWO = range(8)
#: Slices that a worker keeps (about 30 MB), bytes of text that it works on at a time.
KEPT, CHUNK = 400_000, 1 << 20


@lru_cache(1)
def classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 space, 5 other white space, by Unicode's categories and the White_Space property."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        out[i] = 1 if kind == "L" else 2 if kind == "N" else 5 if kind == "Z" else 0
    out[[9, 10, 11, 12, 13, 0x85]] = 5
    out[0x20] = 3
    return out


def _step(state: int, kind: int) -> tuple[int, bool]:
    """State after a character, and whether a pre-token starts at it."""
    if kind == _END:
        return _NONE, True
    if state == _TWO:
        return _ONE, False
    if state == _ONE:
        return _NONE, False
    run = {_L: _IN_L, _N: _IN_N, _O: _IN_O, _C1: _IN_O, _C2: _IN_O}.get(kind)
    if run is not None:
        joins = state in (_AFTER, run)
        if kind in (_C1, _C2) and not joins:
            return (_ONE if kind == _C1 else _TWO), True
        return run, not joins
    if kind == _SP:
        return _AFTER, True
    if kind == _W1:
        return _NONE, True
    return _IN_W, state != _IN_W


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each class, composition table, element and state -> state, class and state -> start."""
    states = range(8)
    make = [tuple(_step(s, k)[0] for s in states) for k in range(9)]
    known = {tuple(states): 0}
    todo = [tuple(states)]
    while todo:
        f = todo.pop()
        for g in make:
            h = tuple(g[f[s]] for s in states)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    by = sorted(known, key=known.get)
    table = np.array([[known[tuple(g[f[s]] for s in states)] for g in by] for f in by], np.uint8 if len(by) <= 256 else np.uint16)
    return np.array([known[g] for g in make], table.dtype), table, np.array(by, np.uint8), np.array([[_step(s, k)[1] for s in states] for k in range(9)])


@lru_cache(1)
def _pairs() -> np.ndarray:
    """Automaton class by the classes of a character and of the next one (4: end of a text), at 8 * own + next."""
    out = np.zeros(64, np.uint8)
    for own in range(6):
        for after in range(6):
            white, goes_on = own in (3, 5), after in (3, 4, 5)
            out[8 * own + after] = (_WS if goes_on else _SP if own == 3 else _W1) if white else (_O, _L, _N, 0, _END)[own]
    return out


def _kinds(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Automaton class of each code point; `ends` are the places where texts end."""
    base = classes().take(points)
    base[ends] = 4
    pair = base << 3
    pair[:-1] |= base[1:]
    pair[-1:] |= 4
    out = _pairs().take(pair)
    quote = np.flatnonzero(points == 0x27)
    quote = quote[base[quote] != 4]
    if len(quote):
        padded = np.concatenate([points, [0, 0]])
        padded[ends] = 0
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("l")) & (two == ord("l"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("r")) & (two == ord("e")))
        out[quote[short]] = _C1
        out[quote[long]] = _C2
    return out


def starts(points: np.ndarray, ends: np.ndarray, width: int = 256) -> np.ndarray:
    """Whether a pre-token starts at each code point; texts end at `ends`, which count as starts."""
    make, table, act, begins = _monoid()
    kinds = _kinds(points, ends)
    n, size = len(kinds), len(table)
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)  # a column of `width` classes for each stretch
    follow = np.ascontiguousarray(table[:, make]).ravel()  # element, then class -> element
    before = np.empty((width, rows), table.dtype)
    total = np.zeros(rows, np.intp)
    for i in range(width):
        before[i] = total
        total = follow.take(total * len(make) + grid[i])
    total = total.astype(np.intp)
    # scan of the stretches' totals by doubling
    flat, reach = table.ravel(), 1
    while reach < rows:
        total[reach:] = flat.take(total[:-reach] * size + total[reach:])
        reach *= 2
    entry = act[np.concatenate([[0], total[:-1]]).astype(np.intp), _NONE]
    out, act, begins = np.empty((rows, width), bool), act.ravel(), begins.ravel()
    for i in range(0, width, 16):  # a few columns at a time, so that no index array is as long as the text
        state = act.take(before[i : i + 16] * np.intp(8) + entry)
        out[:, i : i + 16] = begins.take(grid[i : i + 16] * np.intp(8) + state).T
    return out.reshape(-1)[:n]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def read_merges(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Ids of the tokens of a byte-level vocabulary file in JSON, and its merges in order."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    # printable characters stand for themselves, the other bytes for the code points from 256 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(plain))}
    raw = lambda token: bytes(byte[c] for c in token)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    parts = {x for m in merges for x in (*m, "".join(m))}
    return {raw(t): i for t, i in model["vocab"].items() if t in parts or len(t) == 1}, [(raw(a), raw(b)) for a, b in merges]


class Merger:
    """Merges slices to ids, many at a time: in each the pair of least rank first, the leftmost of equals."""

    _NO = np.int32(1 << 30)

    def __init__(self, ids: dict[bytes, int], pairs: dict[tuple[int, int], tuple[int, int]], whole: bool):
        """pairs: of two ids, the rank and the id of the merged token; whole: a slice that is a token is taken as it is."""
        self.ids, self.whole = ids if whole else {x: i for x, i in ids.items() if len(x) == 1}, whole
        self.byte = np.array([ids[bytes([i])] for i in range(256)], np.int64)
        self.bits = max(10, (8 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self._NO, np.int32)
        self.result = np.zeros(max((r for r, _ in pairs.values()), default=0) + 1, np.int64)
        key = np.array([(a << 20) | b for a, b in pairs], np.int64)
        rank = np.array([r for r, _ in pairs.values()], np.int32)
        self.result[rank] = [i for _, i in pairs.values()]
        at, left = self._home(key), np.arange(len(key))
        while len(left):  # linear probing: of those that want one free place, one gets it
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = key[free]
            left = left[self.keys[at[left]] != key[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        self.ranks[at] = rank

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Rank by key, for slices that are merged one pair at a time."""
        used = self.keys >= 0
        return dict(zip(self.keys[used].tolist(), self.ranks[used].tolist(), strict=True))

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Merger:
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                one, two = ranks.get(token[:i]), ranks.get(token[i:])
                if one is not None and two is not None:
                    pairs[one, two] = (rank, rank)
        return cls(ranks, pairs, True)

    @classmethod
    def of_merges(cls, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> Merger:
        return cls(ids, {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}, False)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        key = (one << 20) | two
        at = self._home(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], self._NO)
        left = np.flatnonzero((held != key) & (held != -1))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            held = self.keys[at[left]]
            same = held == key[left]
            out[left[same]] = self.ranks[at[left[same]]]
            left = left[~same & (held != -1)]
        return out

    def __call__(self, slices: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(slices)
        sizes: dict[int, list[int]] = {}
        for i, piece in enumerate(slices):
            token = self.ids.get(piece) if self.whole or len(piece) == 1 else None
            if token is not None:
                out[i] = [token]
            elif len(piece) <= 32:
                sizes.setdefault(-(-len(piece) // 2) * 2, []).append(i)
            else:
                out[i] = self._long(piece)
        for size, own in sizes.items():
            for at in range(0, len(own), 20_000):
                part = own[at : at + 20_000]
                for i, ids in zip(part, self._same([slices[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def _same(self, slices: list[bytes], size: int) -> list[list[int]]:
        """Of slices of up to `size` bytes: a row each, which closes up after a merge."""
        data = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in slices), np.uint8).reshape(-1, size)
        length = np.fromiter(map(len, slices), np.int64, len(slices))
        tokens, done = self.byte[data], [None] * len(slices)
        ranks = self._rank(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(len(slices), size - 1)
        ranks[np.arange(1, size)[None, :] >= length[:, None]] = self._NO
        rows, place = np.arange(len(slices)), np.arange(size)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            ended = best == self._NO
            if ended.any():
                for r, ids, n in zip(rows[ended].tolist(), tokens[ended].tolist(), length[ended].tolist(), strict=True):
                    done[r] = ids[:n]
                go = ~ended
                rows, tokens, ranks, length, at, best = rows[go], tokens[go], ranks[go], length[go], at[go], best[go]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            tokens[each, at] = self.result[best]
            tokens = np.take_along_axis(tokens, np.minimum(place + (place > at[:, None]), size - 1), 1)
            length = length - 1
            ranks = np.take_along_axis(ranks, np.minimum(place[:-1] + (place[:-1] >= at[:, None]), size - 2), 1)
            ranks[:, -1] = self._NO
            left, right = at > 0, at + 1 < length
            ranks[each[left], at[left] - 1] = self._rank(tokens[each[left], at[left] - 1], tokens[each[left], at[left]])
            ranks[each[right], at[right]] = self._rank(tokens[each[right], at[right]], tokens[each[right], at[right] + 1])
            ranks[each[~right], np.minimum(at[~right], size - 2)] = self._NO
        return done

    def _long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list, for a pre-token of any length."""
        ids = [int(self.byte[x]) for x in piece]
        n = len(ids)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        find = self.pairs.get
        heap = [(p, i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := find(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, one, two = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != one or ids[j] != two:
                continue
            ids[i], gone[j], after[i] = int(self.result[rank]), True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := find(ids[k] << 20 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (p, k, ids[k], ids[after[k]]))
        return [ids[i] for i in range(n) if not gone[i]]


class Slices:
    """Ids of pre-token slices, each merged once: a hash table in arrays, emptied when it holds `most` slices.

    A slice is known by a hash of all its bytes, its first eight bytes and its length.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = KEPT):
        self.encode, self.most, self.bits = encode, most, (4 * most).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.count, self.known = 0, np.zeros((1 << 12, 2), np.uint64)
        self.flat, self.ends = np.zeros(1 << 14, np.int32), np.zeros(1, np.int64)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entry of each slice, else -1."""
        at = self._home(key)
        out = self.slot.take(at)
        left = np.flatnonzero((out >= 0) & ((self.known[out, 0] != key) | (self.known[out, 1] != check)))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slot) - 1)
            entry = self.slot[at[left]]
            out[left] = entry
            left = left[(entry >= 0) & ((self.known[entry, 0] != key[left]) | (self.known[entry, 1] != check[left]))]
        return out

    def ids(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's first id (plus the end)."""
        data, starts, ends, at = cut(texts)
        if self.count > self.most:
            self._clear()
        padded = np.frombuffer(data + b"\0" * 8, np.uint8)
        key, check = words.digest(padded, starts, ends), words.opening(padded, starts, ends)
        own = self._find(key, check)
        while len(miss := np.flatnonzero(own < 0)):
            _, first = np.unique(key[miss], return_index=True)
            new = miss[first]
            self._add([data[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], key[new], check[new])
            own[miss] = self._find(key[miss], check[miss])
        first, length = self.ends[own], self.ends[own + 1] - self.ends[own]
        stop = np.concatenate([[0], np.cumsum(length)])
        return self.flat[np.repeat(first - stop[:-1], length) + np.arange(stop[-1])], stop[at]

    def _add(self, slices: list[bytes], key: np.ndarray, check: np.ndarray) -> None:
        n = len(slices)
        while self.count + n > 1 << (self.bits - 1):  # a batch with more new slices than the table was made for
            self._grow()
        lists = self.encode(slices)
        ends = self.ends[-1] + np.cumsum([len(x) for x in lists])
        self.flat = _room(self.flat, int(ends[-1]))
        self.flat[self.ends[-1] : ends[-1]] = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1] - self.ends[-1]))
        self.ends = np.concatenate([self.ends, ends])
        self.known = _room(self.known, self.count + n)
        self.known[self.count : self.count + n] = np.stack([key, check], 1)
        self._place(np.arange(self.count, self.count + n, dtype=np.int32))
        self.count += n

    def _place(self, entries: np.ndarray) -> None:
        """Linear probing: of the entries that want one free place, one gets it and the others go on."""
        at, left = self._home(self.known[entries, 0]), np.arange(len(entries))
        while len(left):
            free = left[self.slot[at[left]] < 0]
            self.slot[at[free]] = entries[free]
            left = left[self.slot[at[left]] != entries[left]]
            at[left] = (at[left] + 1) & (len(self.slot) - 1)

    def _grow(self) -> None:
        self.bits += 1
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self._place(np.arange(self.count, dtype=np.int32))


def _room(array: np.ndarray, count: int) -> np.ndarray:
    if count <= len(array):
        return array
    out = np.zeros((max(count, 2 * len(array)), *array.shape[1:]), array.dtype)
    out[: len(array)] = array
    return out


def cut(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, start and end of each pre-token, and the index of each text's first one (plus the end)."""
    data = b"\0".join([*(x or b"" for x in texts), b""])
    chars = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    closes = np.cumsum([len(x or b"") + 1 for x in texts]) - 1
    if len(chars) == len(data):
        first = np.flatnonzero(starts(chars, closes))
        stop, bound = closes, first
    else:
        byte = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # first byte of each character
        stop = np.searchsorted(byte, closes)
        first = np.flatnonzero(starts(chars, stop))
        bound = byte[first]
    ends = np.searchsorted(first, stop)  # texts' ends among the starts
    keep = np.ones(len(first), bool)
    keep[ends] = False
    return data, bound[keep], np.append(bound[1:], len(data))[keep], np.concatenate([[0], ends - np.arange(len(ends))])


@lru_cache(4)
def slices_of_ranks(path: str) -> Slices:
    """The slices that this worker process has met, kept from task to task."""
    return Slices(Merger.of_ranks(read_ranks(path)))


@lru_cache(4)
def slices_of_merges(path: str) -> Slices:
    return Slices(Merger.of_merges(*read_merges(path)))


class Decoder:
    """Bytes of ids: each token's are written at its offset."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.get)
        self.place, self.sizes = (np.zeros(max(ranks.values()) + 2, np.int64) for _ in range(2))
        total = 0
        for token in tokens:
            self.place[ranks[token]], self.sizes[ranks[token]] = total, len(token)
            total += len(token)
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        length = self.sizes[ids]
        out = np.zeros(int((offsets + length).max(initial=0)), np.uint8)
        # byte j of the token at an offset goes to that offset plus j
        j = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(offsets.astype(np.int64), length) + j] = self.letters[np.repeat(self.place[ids], length) + j]
        return out.tobytes()


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def _encoding(path: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, back = slices_of_ranks(path), decoder(path)
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for a, b in words.chunks(texts, CHUNK):
                flat, at = kept.ids(texts.slice(a, b - a).to_pylist())
                ends = np.cumsum(back.sizes[flat])
                base = np.repeat(np.concatenate([[0], ends])[at[:-1]], np.diff(at))
                offsets = (ends - back.sizes[flat] - base).astype(np.int32)
                bounds = pa.array(at.astype(np.int32))
                columns = [batch["doc_id"].slice(a, b - a), pa.ListArray.from_arrays(bounds, pa.array(flat)), pa.ListArray.from_arrays(bounds, pa.array(offsets))]
                if decode:
                    columns[2] = pa.array([back(flat[x:y], offsets[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded" if decode else "offsets"])

    return run


def _decoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(path)
        for batch in batches:
            decoded = [back(ids.values.to_numpy(), offsets.values.to_numpy()) for ids, offsets in zip(batch["ids"], batch["offsets"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return run


_CODED = "doc_id long, ids array<int>, "


def bpe_encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, offsets), one row per input row; other columns are not read.

    ids are those of the rank file's vocabulary for each pre-token on its own, without special tokens; offsets
    are the tokens' first bytes in the UTF-8 text. Null and empty texts have no ids. Null ids and repeated rows
    are kept as they are. No rows: no rows. The vocabulary file must lie at that path on every executor.
    """
    return _texts(docs, id_col, text_col).mapInArrow(_encoding(ranks_path, False), _CODED + "offsets array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for, each token's at its offset. No ids: no bytes."""
    return encoded.select("doc_id", "ids", "offsets").mapInArrow(_decoding(ranks_path), _CODED + "decoded binary")


def bpe_round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): bpe_encode() and bpe_decode() in one worker, with half the processes and copies."""
    return _texts(docs, id_col, text_col).mapInArrow(_encoding(ranks_path, True), _CODED + "decoded binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
