"""Words of whole texts as arrays of 64-bit hashes, without a Python loop over words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D in the UTF-8 form of the text.
A word's hash depends on its bytes and length only, so it is the same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_M1, _M2, _M3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))
_KEEP = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def chunks(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of a string or binary column of about so many bytes each (a longer text stands alone)."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)) if len(column) else np.zeros(0, np.int64)
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield at, to
        at = to


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by one space and all by eight more, and each text's start (plus the end)."""
    lengths = np.fromiter((len(x or b"") + 1 for x in texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join([*(x or b"" for x in texts), b" " * 8]), np.uint8)
    return data, np.concatenate([[0], np.cumsum(lengths)])


def hashed(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and for each text the index of its first word (plus the end)."""
    data, at = joined(texts)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    return digest(_LOWER[data] if lower else data, starts, ends), np.searchsorted(starts, at)


def digest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range; `data` goes on for eight bytes after the last."""
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data), 0, (1,))
    length = ends - starts
    out = mix(length.astype(np.uint64) * _M3 * _M3 ^ (eight[starts] & _KEEP[np.minimum(length, 8)]))
    live, done = np.flatnonzero(length > 8), 8
    while len(live):
        left = length[live] - done
        block = eight[starts[live] + done] & _KEEP[np.minimum(left, 8)]
        out[live] = mix(out[live] * _M3 ^ block)
        done += 8
        live = live[left > 8]
    return out


def opening(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each range and its length, as one number."""
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data), 0, (1,))
    length = ends - starts
    return (eight[starts] & _KEEP[np.minimum(length, 8)]) + length.astype(np.uint64) * _M1


def rolled(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """One hash for every n consecutive words (none if there are fewer)."""
    if len(words) < n:
        return words[:0]
    turn = np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * turn[k]
    return mix(total)
