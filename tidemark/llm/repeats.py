"""Substring dedup: drop words of passages that already stand earlier in the corpus.

Documents are dealt into blocks of some megabytes by a hash of their id, so that every later step
can send something back to a block. Two question-and-answer rounds follow.

1. Each block sketches its windows: two hash rows, in each the sorted cells it fills, cut into cell
   ranges. The sketches of a range are merged by addition; a block gets back, for each of its
   cells, whether the merged count is 2 or more. A count-min sketch never underestimates, so a
   window that occurs twice is hot in both rows.
2. Only windows hot in both rows go on. Each block sends one digest of 96 bits per distinct one,
   with its first place in the block; equal digests meet, the earliest place wins, and each block
   is told which of its windows are repeated and whether it holds the first.

A block sends a window once, however often it has it, so a passage that a third of all documents
share costs one row per block. The sketch is as wide as the corpus asks for (four cells for each
expected window) and is spread over its cell ranges; nothing of it is broadcast.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import text_bytes

ROWS = 2
LAST = np.iinfo(np.int64).max
_SKETCH = "row int, cells_of int, block long, cells binary, many binary"
_HOT = "block long, row int, cells_of int, hot binary"
_ASK = "digests_of int, block long, hi binary, lo binary, doc binary, place binary, many binary"
_ANSWER = "block long, place binary, leads binary"


def _pack(a: np.ndarray) -> bytes:
    """Unsigned numbers in the least of 1, 2, 4 or 8 bytes each."""
    top = int(a.max()) if len(a) else 0
    size = next(s for s in (1, 2, 4, 8) if top < 1 << 8 * s)
    return bytes([size]) + a.astype(f"<u{size}").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.uint64)


def _bits(a: np.ndarray) -> bytes:
    return np.packbits(a).tobytes()


def _unbits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


class _Block:
    """Words and windows of a block, its documents in order of id, then text."""

    def __init__(self, rows: pa.Table, key: str, text: str, k: int):
        keys = [(key, "ascending"), (text, "ascending")]
        self.rows = rows.sort_by(keys).combine_chunks()
        column = self.rows.column(text)
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
        self.parts, self.words, hi, lo, start, doc = [], 0, [], [], [], []
        for a, _, w in W.runs(column):
            at = W.window_starts(w, k)
            one = W.hashes(w)
            hi.append(W.windows(one, k)[at])
            lo.append(W.windows(W.mix(one ^ W.U(0x5851F42D4C957F2D)), k)[at])
            start.append(at + self.words)
            doc.append(W.owner(w)[at] + a)
            self.parts.append((a, w, self.words))
            self.words += len(w.starts)
        none = np.zeros(0, np.uint64)
        self.hi, self.lo = np.concatenate([none, *hi]), np.concatenate([none, *lo])
        self.start, self.doc = (np.concatenate([none.astype(np.int64), *x]) for x in (start, doc))

    def ids(self, key: str) -> np.ndarray:
        return np.asarray(self.rows.column(key).cast(pa.int64()).fill_null(LAST))

    def cells(self, row: int, bits: int) -> np.ndarray:
        return (self.lo if row else self.hi) >> np.uint64(64 - bits)


def _sketch(k: int, key: str, text: str, bits: int, cut: int):
    def sketch(block, rows):
        b = _Block(rows, key, text, k)
        out = []
        for row in range(ROWS):
            cells, count = np.unique(b.cells(row, bits), return_counts=True)
            part = (cells >> np.uint64(bits - cut)).astype(np.int64)
            edges = np.searchsorted(part, np.arange((1 << cut) + 1))
            for r in np.flatnonzero(np.diff(edges)):
                c = cells[edges[r]:edges[r + 1]] - np.uint64(int(r) << bits - cut)
                step = np.diff(c, prepend=np.uint64(0))
                out.append((row, int(r), block[0].as_py(), _pack(step),
                            _bits(count[edges[r]:edges[r + 1]] > 1)))
        return _table(out, _SKETCH)

    return sketch


def _merge(bits: int, cut: int):
    def merge(key, rows):
        count = np.zeros(1 << bits - cut, np.uint8)
        blobs = list(zip(rows["block"].to_pylist(), rows["cells"].to_pylist(), rows["many"].to_pylist()))
        for _, cells, many in blobs:
            c = np.cumsum(_unpack(cells)).astype(np.int64)
            count[c] = np.minimum(count[c] + 1 + _unbits(many, len(c)), 2)
        out = []
        for block, cells, _ in blobs:
            hot = count[np.cumsum(_unpack(cells)).astype(np.int64)] > 1
            if hot.any():
                out.append((block, key[0].as_py(), key[1].as_py(), _bits(hot)))
        return _table(out, _HOT)

    return merge


def _ask(k: int, key: str, text: str, bits: int, cut: int):
    def ask(block, rows, hot):
        if not rows.num_rows or not hot.num_rows:
            return _table([], _ASK)
        b = _Block(rows, key, text, k)
        likely = np.ones(len(b.hi), bool)
        for row in range(ROWS):
            cells, back = np.unique(b.cells(row, bits), return_inverse=True)
            edges = np.searchsorted((cells >> np.uint64(bits - cut)).astype(np.int64), np.arange((1 << cut) + 1))
            warm = np.zeros(len(cells), bool)
            for r, part, got in zip(hot["row"].to_pylist(), hot["cells_of"].to_pylist(), hot["hot"].to_pylist()):
                if r == row:
                    warm[edges[part]:edges[part + 1]] = _unbits(got, edges[part + 1] - edges[part])
            likely &= warm[back]
        at = np.flatnonzero(likely)
        at = at[np.lexsort((at, b.lo[at], b.hi[at]))]
        hi, lo = b.hi[at], b.lo[at] >> np.uint64(32)
        new = np.ones(len(at), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        heads = np.flatnonzero(new)
        many = np.diff(heads, append=len(at)) > 1
        hi, lo, at = hi[heads], lo[heads], at[heads]
        doc = b.ids(key)[b.doc[at]].view(np.uint64) ^ np.uint64(1 << 63)  # keeps the order of signed ids
        edges = np.searchsorted(hi >> np.uint64(64 - cut), np.arange((1 << cut) + 1))
        out = []
        for r in np.flatnonzero(np.diff(edges)):
            s = slice(edges[r], edges[r + 1])
            low = doc[s].min()
            out.append((int(r), block[0].as_py(), hi[s].tobytes(), lo[s].astype("<u4").tobytes(),
                        int(low).to_bytes(8, "little") + _pack(doc[s] - low), _pack(at[s]), _bits(many[s])))
        return _table(out, _ASK)

    return ask


def _answer(key, rows):
    """Who holds the first of each digest: the smallest document id, then block and place."""
    got = rows.sort_by([("block", "ascending")]).to_pylist()
    size = [len(r["lo"]) // 4 for r in got]
    hi = np.concatenate([np.frombuffer(r["hi"], "<u8") for r in got])
    lo = np.concatenate([np.frombuffer(r["lo"], "<u4") for r in got])
    doc = np.concatenate([_unpack(r["doc"][8:]) + np.uint64(int.from_bytes(r["doc"][:8], "little")) for r in got])
    place = np.concatenate([_unpack(r["place"]) for r in got])
    many = np.concatenate([_unbits(r["many"], n) for r, n in zip(got, size)])
    of = np.repeat(np.arange(len(got)), size)
    order = np.lexsort((place, of, doc, lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    group = np.cumsum(new) - 1
    repeated = np.bincount(group) > 1
    repeated |= np.bincount(group, many[order]) > 0
    tell, leads = np.zeros(len(order), bool), np.zeros(len(order), bool)
    tell[order], leads[order] = repeated[group], new
    cuts = np.concatenate([[0], np.cumsum(size)])
    out = []
    for i, r in enumerate(got):
        s = slice(cuts[i], cuts[i + 1])
        if tell[s].any():
            out.append((r["block"], _pack(place[s][tell[s]]), _bits(leads[s][tell[s]])))
    return _table(out, _ANSWER)


def _finish(k: int, key: str, text: str, schema: T.StructType, with_text: bool):
    def finish(block, rows, answers):
        b = _Block(rows, key, text, k)
        covered = np.zeros(b.words + 1, np.int64)
        if answers.num_rows:
            place = np.concatenate([_unpack(x) for x in answers["place"].to_pylist()]).astype(np.int64)
            leads = np.concatenate([_unbits(x, (len(p) - 1) // p[0]) for x, p in zip(
                answers["leads"].to_pylist(), answers["place"].to_pylist())])
            order = np.argsort(b.hi[place])
            place, leads = place[order], leads[order]
            told = b.hi[place]
            i = np.minimum(np.searchsorted(told, b.hi), len(told) - 1)
            gone = (told[i] == b.hi) & (b.lo[place[i]] >> np.uint64(32) == b.lo >> np.uint64(32))
            gone &= ~(leads[i] & (place[i] == np.arange(len(b.hi))))
            np.add.at(covered, b.start[gone], 1)
            np.add.at(covered, b.start[gone] + k, -1)
        drop = np.cumsum(covered)[:-1] > 0
        n_words, n_removed, digest, kept = [], [], [], []
        for _, w, base in b.parts:
            for d in range(len(w.first) - 1):
                lost = drop[base + w.first[d]:base + w.first[d + 1]]
                n_words.append(len(lost))
                n_removed.append(int(lost.sum()))
                one = w.text(d) if not n_removed[-1] else b" ".join(
                    x for x, y in zip(w.of(d), lost.tolist()) if not y)
                digest.append(hashlib.sha256(one).hexdigest())
                if with_text:
                    kept.append(one.decode() if n_removed[-1] else None)
        out = {c: b.rows.column(c) for c in b.rows.column_names if c in schema.names and c != text}
        if with_text:
            old = b.rows.column(text).to_pylist()
            out[text] = pa.array([o if x is None else x for o, x in zip(old, kept)], pa.string())
        out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "kept_sha256": pa.array(digest, pa.string())}
        return pa.table([out[f] for f in schema.names], names=schema.names)

    return finish


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in fields]
    W.give_back()
    return pa.table([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def remove_repeats(docs: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text",
                   with_text: bool = True, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` without the words of ``k``-word windows that also start earlier.

    Earlier means a smaller ``key``, or the same document and an earlier start; windows are judged
    on the input. Adds ``n_words``, ``n_removed`` and ``kept_sha256`` (of the kept words joined by
    one space); input columns of these names are replaced. With ``with_text`` the text of a
    document that lost words becomes its kept words joined by one space, any other text stays as
    it is; without, the other columns are dropped too.

    A null text has no words and stays null. Rows that share a key are ordered by their text; a null
    key counts as later than any other. An empty table gives an empty result.
    """
    added = ("n_words", "n_removed", "kept_sha256")
    docs = docs.select(*[c for c in docs.columns if c not in added]) if with_text else docs.select(key, text)
    size = text_bytes(docs, text)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(math.ceil(size / block_bytes), 2 * width)
    bits = min(62, max(20, math.ceil(math.log2(4 * (size / 6 + 1)))))
    cut = max(6, bits - 22)
    inner = "__block"
    while inner in docs.columns:
        inner += "_"
    dealt = docs.withColumn(inner, F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("long"), F.xxhash64(text))),
                                          F.lit(blocks)))
    out = T.StructType([f for f in docs.schema if with_text or f.name != text]
                       + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                          T.StructField("kept_sha256", T.StringType())])
    rows = dealt.groupBy(inner)
    hot = rows.applyInArrow(_sketch(k, key, text, bits, cut), _SKETCH).groupBy("row", "cells_of").applyInArrow(
        _merge(bits, cut), _HOT)
    asked = rows.cogroup(hot.groupBy("block")).applyInArrow(_ask(k, key, text, bits, cut), _ASK)
    told = asked.groupBy("digests_of").applyInArrow(_answer, _ANSWER)
    return rows.cogroup(told.groupBy("block")).applyInArrow(_finish(k, key, text, out, with_text), out)
