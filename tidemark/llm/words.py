"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space and 0x09 to 0x0D. Word and window hashes are 64 bits
wide; callers that need more take two seeds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Texts are taken in runs of about so many bytes, so that the arrays stay small.
RUN_BYTES = 1 << 20
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_LONG = 128  # longer words are hashed one by one


def give_back() -> None:
    """Return freed memory to the system; a worker serves many stages and would else keep the largest."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Words(NamedTuple):
    """Words of consecutive texts: byte spans, and for each text the number of its first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # texts + 1

    def text(self, i: int) -> bytes:
        """Words of text ``i`` joined by one space."""
        return b" ".join(self.of(i))

    def of(self, i: int) -> list[bytes]:
        """Words of text ``i``."""
        a, b = self.first[i], self.first[i + 1]
        return self.data[self.starts[a]:self.ends[b - 1]].tobytes().split() if b > a else []


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), off


def runs(column: pa.Array, fold: bool = False) -> Iterator[tuple[int, int, Words]]:
    """``(from, to, words)`` for runs of rows; null is an empty text. ``fold`` lower-cases A-Z.

    After the last run freed memory goes back, so that an idle worker keeps little of what a batch took.
    """
    data, off = _bytes_of(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + RUN_BYTES, side="right")) - 1)
        part, cuts = data[off[at]:off[to]], off[at:to + 1] - off[at]
        yield at, to, split(_FOLD[part] if fold else part, cuts)
        at = to
    give_back()


def split(data: np.ndarray, cuts: np.ndarray) -> Words:
    """Words of the texts ``data[cuts[i]:cuts[i + 1]]``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(cuts), np.int64))
    inside = ~_GAP[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = cuts[cuts < len(data)]
    begin[edge] = inside[edge]
    edge = cuts[cuts > 0] - 1
    end[edge] = inside[edge]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, cuts))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (in place)."""
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def hashes(w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word, the same wherever the word stands."""
    size = w.ends - w.starts
    h = mix(size.astype(U) * U(0x9E3779B97F4A7C15) + U(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    if not len(size):
        return h
    padded = np.concatenate([w.data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(w.data) + 1, "<u8", padded, 0, (1,))
    live = np.flatnonzero(size <= _LONG)
    for j in range(0, _LONG, 8):
        left = size[live] - j
        live, left = live[left > 0], left[left > 0]
        if not len(live):
            break
        lane = lanes[w.starts[live] + j].astype(U)
        lane &= U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * np.minimum(left, 8).astype(U))
        x = (h[live] ^ lane) * U(0x9FB21C651E98DF25)
        h[live] = x ^ (x >> U(29))
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(w.data[w.starts[i]:w.ends[i]].tobytes(), seed)
    return mix(h)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of ``k`` consecutive words for every place where ``k`` words follow."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, width, acc, at = None, 1, h, 0
    left = k
    while True:  # windows of 1, 2, 4, ... words; those of k's binary digits are put together
        if left & 1:
            part = acc[at:at + n]
            out = part.copy() if out is None else out * U(0xD6E8FEB86659FD93) + part
            at += width
        left >>= 1
        if not left:
            return mix(out)
        p = U((0xA0761D6478BD642F + 2 * width * 0xE7037ED1A0B428DB) & (1 << 64) - 1 | 1)
        acc = acc[:-width] * p + acc[width:]
        acc ^= acc >> U(32)
        width *= 2


def window_starts(w: Words, k: int) -> np.ndarray:
    """Word numbers at which ``k`` words of one text follow."""
    n = len(w.starts) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for j in range(1, k):  # a text may begin anywhere but inside the window
        cut = w.first[1:-1] - j
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return np.flatnonzero(ok)


def owner(w: Words) -> np.ndarray:
    """The text of every word."""
    return np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
