"""Line-level text helpers used inside tasks, one pair of texts at a time."""

from __future__ import annotations

import difflib
import math

import numpy as np


def union_lines(x: str, y: str, budget: int | None = None) -> str:
    """Lossless union of two texts given in canonical order.

    Lines of a longest common subsequence appear once; between them come the lines of
    ``x``, then of ``y``. Above ``budget`` line pairs the texts are put one after the other; None
    is no budget.
    """
    if x == y:
        return x
    a, b = x.split("\n"), y.split("\n")
    if budget is not None and len(a) * len(b) > budget:
        return x + "\n" + y
    out: list[str] = []
    i = j = 0
    for anchor in _common_lines(a, b):
        ai, bj = a.index(anchor, i), b.index(anchor, j)
        out += a[i:ai] + b[j:bj] + [anchor]
        i, j = ai + 1, bj + 1
    return "\n".join(out + a[i:] + b[j:])


def _common_lines(a: list[str], b: list[str]) -> list[str]:
    """A longest common subsequence. Of the table's rows, every ``step``-th and those of one step are held."""
    codes = {line: n for n, line in enumerate(dict.fromkeys(a + b))}
    ca, cb = np.array([codes[s] for s in a]), np.array([codes[s] for s in b])

    def above(i: int, below: np.ndarray) -> np.ndarray:
        # A row is the best of skipping a[i] or pairing it, carried leftwards over skips of b.
        paired = np.where(cb == ca[i], below[1:] + 1, 0)
        row = np.zeros_like(below)
        row[:-1] = np.maximum.accumulate(np.maximum(below[:-1], paired)[::-1])[::-1]
        return row

    step = math.isqrt(len(a)) + 1
    row = np.zeros(len(b) + 1, dtype=np.int32)
    held = {len(a): row}
    for i in range(len(a) - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            held[i] = row
    found: list[str] = []
    i = j = 0
    for start in range(0, len(a), step):
        end = min(start + step, len(a))
        best = [held[end]]
        for k in range(end - 1, start - 1, -1):
            best.append(above(k, best[-1]))
        best.reverse()
        while i < end and j < len(b):
            if ca[i] == cb[j]:
                found.append(a[i])
                i, j = i + 1, j + 1
            elif best[i + 1 - start][j] >= best[i - start][j + 1]:
                i += 1
            else:
                j += 1
    return found


def merge3(base: str, ours: str, theirs: str) -> str | None:
    """Apply the line changes ``base -> theirs`` to ``ours``; None when both touch a region."""
    b, o, t = (s.split("\n") for s in (base, ours, theirs))

    def edits(other: list[str]) -> list[tuple[int, int, tuple[str, ...]]]:
        ops = difflib.SequenceMatcher(None, b, other, autojunk=False).get_opcodes()
        return [(i1, i2, tuple(other[j1:j2])) for tag, i1, i2, j1, j2 in ops if tag != "equal"]

    mine, other = edits(o), edits(t)
    for m in mine:
        for n in other:
            if m != n and m[0] <= n[1] and n[0] <= m[1]:
                return None
    out: list[str] = []
    at = 0
    for start, end, lines in sorted(set(mine) | set(other)):
        out += b[at:start] + list(lines)
        at = end
    return "\n".join(out + b[at:])


def char_edits(old: str, new: str) -> list[tuple[int, str, str]]:
    """Insert/delete operations that turn ``old`` into ``new`` when applied in order.

    Each is ``(position, 'ins' | 'del', char)``, the position counted in the text as it is
    at that moment. Lines are compared first, characters only inside changed blocks.
    """
    ops: list[tuple[int, str, str]] = []
    a, b = old.splitlines(keepends=True), new.splitlines(keepends=True)
    at = 0
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        before, after = "".join(a[i1:i2]), "".join(b[j1:j2])
        if tag == "equal":
            at += len(before)
            continue
        inner = difflib.SequenceMatcher(None, before, after, autojunk=False).get_opcodes() \
            if before and after else [("replace", 0, len(before), 0, len(after))]
        for sub, p1, p2, q1, q2 in inner:
            if sub == "equal":
                at += p2 - p1
                continue
            ops += [(at, "del", c) for c in before[p1:p2]]
            ops += [(at + n, "ins", c) for n, c in enumerate(after[q1:q2])]
            at += q2 - q1
    return ops


def apply_edits(old: str, ops: list[tuple[int, str, str]]) -> str:
    chars = list(old)
    for pos, op, c in ops:
        if op == "del":
            del chars[pos]
        else:
            chars.insert(pos, c)
    return "".join(chars)
