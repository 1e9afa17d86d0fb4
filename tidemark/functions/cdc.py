"""Content-defined cut points, vectorised per file."""

from __future__ import annotations

import hashlib

import numpy as np

# One 32-bit value per byte, taken from the digest of the byte itself.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big")
                 for b in range(256)], dtype=np.uint32)


def cut_points(data: bytes, low: int, avg: int, high: int) -> list[int]:
    """End offsets of the chunks of ``data``.

    The rolling value shifts left once per byte, so the low ``n`` bits at a position depend
    on its last ``n`` bytes only: both masks are evaluated for all positions at once, and
    just the walk from cut to cut is sequential.
    """
    size = len(data)
    bits = avg.bit_length() - 1
    width = bits + 1
    if not width <= low <= avg <= high:
        raise ValueError("need mask width <= min <= avg <= max")
    if size == 0:
        return []
    if size <= low:
        return [size]
    gear = GEAR[np.frombuffer(data, dtype=np.uint8)]
    rolled = gear.copy()
    for back in range(1, width):
        rolled[back:] += gear[:-back] << np.uint32(back)
    strict = np.flatnonzero((rolled & np.uint32((1 << (bits + 1)) - 1)) == 0) + 1
    loose = np.flatnonzero((rolled & np.uint32((1 << max(bits - 1, 0)) - 1)) == 0) + 1
    ends: list[int] = []
    at = 0
    while at < size:
        if size - at <= low:
            ends.append(size)
            break
        end = _next(strict, at + low, min(at + avg, size))
        if end is None:
            end = _next(loose, at + avg, min(at + high, size))
        at = min(at + high, size) if end is None else end
        ends.append(at)
    return ends


def _next(candidates: np.ndarray, after: int, upto: int) -> int | None:
    i = int(np.searchsorted(candidates, after, side="right"))
    return int(candidates[i]) if i < len(candidates) and candidates[i] <= upto else None
