"""Benchmark decontamination by spaced seeds.

A mask such as ``1101`` picks some of the words under it, so a seed still matches when a word it
skips was changed. Every place of every test item is hashed under each mask; every place of every
training text is hashed the same way and looked up. Around a hit the two texts are compared word
by word along the hit's diagonal, which decides.

A test item is hashed under the first family of masks of which every overlap of it, wherever its
changed words stand, holds one; `finds_all` tries all of them. So seeds cost no result.

The test items come in blocks of at most ``BLOCK_WORDS`` words (about 40 MB with their seeds), each
broadcast; a larger benchmark takes one pass over the texts per block. The texts never shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import ascii_lower

#: Families of masks, the most selective first; the last finds whatever has one equal word.
MASKS = (("11111", "111101", "101111"), ("1111",), ("111", "1101", "1011"), ("111",), ("11", "101"), ("11",), ("1",))
BLOCK_WORDS = 500_000
_FILTER_BITS = 22
_OUT = "doc_id long, item_id long, n_matched long, n_item_words long, first_word long, last_word long"


def _masked(h: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The hash under a mask at every place where the whole mask fits."""
    n = len(h) - int(picks[-1])
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(picks) * 64 + int(picks[-1]), np.uint64)
    for j in picks:
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j:j + n]
    return W.mix(out)


def needed(size: int, least: int, percent: int) -> int:
    """Equal words that make an overlap with an item of ``size`` words."""
    return min(least, -(-size * percent // 100))


@lru_cache(maxsize=10_000)
def finds_all(family: tuple[str, ...], longest: int, need: int, percent: int) -> bool:
    """Whether each stretch of at most ``longest`` words with ``need`` equal ones, and ``percent``, holds a mask.

    Stretches grow word by word as (last words, equal words), as long as no mask has come up.
    """
    span = max(map(len, family))
    masks = [(int(m, 2), (1 << len(m)) - 1) for m in family]
    live = {(0, 0)}
    for size in range(1, longest + 1):
        grown = set()
        for last, equal in live:
            for same in (0, 1):
                now = (last << 1 | same) & (1 << span) - 1
                if not any(now & mask == mask for mask, _ in masks):
                    grown.add((now, equal + same))
        if any(equal >= need and 100 * equal >= percent * size for _, equal in grown):
            return False
        live = grown
    return True


def family_of(size: int, least: int, percent: int, masks=MASKS) -> tuple[str, ...]:
    """The first family that finds every overlap with an item of ``size`` words.

    Of a longer stretch one half is as equal, so an overlap of twice ``need / percent`` words and more
    holds a shorter one, and only lengths below that are tried.
    """
    need = needed(size, least, percent)
    longest = min(size, 2 * -(-100 * need // percent) + 1)
    return next((f for f in masks if finds_all(tuple(f), longest, need, percent)), ("1",))


def index_items(rows: list[tuple[int, str]], masks=MASKS, min_words: int = 1, least: int = 13,
                percent: int = 80) -> SimpleNamespace:
    """Test items, their seeds sorted by hash, and a bit filter over the seeds' leading bits.

    An item of fewer than ``min_words`` words is left out. Of equal items the smallest id stands for all."""
    seen: dict[bytes, int] = {}
    ids, words = [], []
    column = pa.array([t for _, t in rows], pa.string())
    for a, _, w in W.runs(column, fold=True):
        h = W.hashes(w)
        for i in range(len(w.first) - 1):
            x = h[w.first[i]:w.first[i + 1]]
            if len(x) >= min_words and x.tobytes() not in seen:
                seen[x.tobytes()] = 1
                ids.append(rows[a + i][0])
                words.append(x)
    families = [family_of(len(x), least, percent, masks) for x in words]
    picks, keys, item, place = [], [], [], []
    for m in sorted({m for f in families for m in f}):
        p = np.flatnonzero(np.array(list(m)) == "1")
        picks.append(p)
        for i, x in enumerate(words):
            if m not in families[i]:
                continue
            k = _masked(x, p)
            keys.append(k)
            item.append(np.full(len(k), i))
            place.append(np.arange(len(k)))
    keys = np.concatenate([np.zeros(0, np.uint64), *keys])
    item, place = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (item, place))
    order = np.argsort(keys)
    filters = np.zeros(1 << _FILTER_BITS, bool)
    filters[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return SimpleNamespace(ids=np.array(ids, np.int64), words=words, masks=picks, filters=filters,
                           keys=keys[order], item=item[order], place=place[order])


def _extend(same: np.ndarray, need: int, percent: int) -> tuple[int, int, int] | None:
    """The best stretch with ``need`` equal words and ``percent``: from, to, equal words; None if there is none.

    Best is most matches over mismatches (a mismatch costs 2), then the first end, then the first start.
    """
    if int(same.sum()) < need:
        return None
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    equal = np.concatenate([[0], np.cumsum(same)])
    low = np.minimum.accumulate(score)
    to = int(np.argmax(score - low))
    at = int(np.argmin(score[:to + 1]))
    n = int(equal[to] - equal[at])
    if n >= need and 100 * n >= percent * (to - at):
        return at, to, n
    # A stretch has the percentage when its sum does not fall; the first start of no greater sum is the longest.
    sums = 100 * equal - percent * np.arange(len(equal))
    first = np.searchsorted(-np.minimum.accumulate(sums), -sums, side="left")
    ends = np.flatnonzero(equal - equal[first] >= need)
    if not len(ends):
        return None
    # Least score among starts of no greater sum that are far enough before each end: a tree of minima over ranks.
    _, rank = np.unique(sums, return_inverse=True)
    size = int(rank.max()) + 1
    tree: list[tuple[int, int] | None] = [None] * (size + 1)
    ready = np.searchsorted(equal, equal[ends] - need, side="right").tolist()
    best, begin = (-3 * len(same), 0, 0), 0
    for to, upto in zip(ends.tolist(), ready):
        for begin in range(begin, upto):
            i, entry = int(rank[begin]) + 1, (int(score[begin]), begin)
            while i <= size:
                if tree[i] is None or entry < tree[i]:
                    tree[i] = entry
                i += i & -i
        begin = max(begin, upto)
        i, least = int(rank[to]) + 1, None
        while i:
            if tree[i] is not None and (least is None or tree[i] < least):
                least = tree[i]
            i -= i & -i
        if int(score[to]) - least[0] > best[0]:
            best = (int(score[to]) - least[0], least[1], to)
    _, at, to = best
    return at, to, int(equal[to] - equal[at])


def _matches(w: W.Words, items: SimpleNamespace, least: int, percent: int) -> dict[tuple[int, int], tuple]:
    """Best overlap for each (text of the run, item)."""
    found: dict[tuple[int, int], tuple] = {}
    h = W.hashes(w)
    checked: set[tuple[int, int, int]] = set()
    for p in items.masks:
        seed = _masked(h, p)
        at = np.flatnonzero(items.filters[(seed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        left, right = (np.searchsorted(items.keys, seed[at], side=s) for s in ("left", "right"))
        hit = right > left
        for d, a, b in zip(at[hit].tolist(), left[hit].tolist(), right[hit].tolist()):
            doc = int(np.searchsorted(w.first, d, side="right")) - 1
            if d + int(p[-1]) >= w.first[doc + 1]:
                continue  # the mask reaches into the next text
            for s in range(a, b):
                item, diagonal = int(items.item[s]), d - int(items.place[s])
                if (doc, item, diagonal) in checked:
                    continue
                checked.add((doc, item, diagonal))
                x = items.words[item]
                lo = max(0, int(w.first[doc]) - diagonal)
                hi = min(len(x), int(w.first[doc + 1]) - diagonal)
                need = needed(len(x), least, percent)
                stretch = _extend(x[lo:hi] == h[diagonal + lo:diagonal + hi], need, percent)
                if stretch:
                    f, t, n = stretch
                    start = diagonal + lo + f - int(w.first[doc])
                    best, old = (n, len(x), start, start + t - f - 1), found.get((doc, item))
                    if old is None or (n, -start) > (old[0], -old[2]):
                        found[doc, item] = best
    return found


def _blocks(benchmark: DataFrame, key: str, text: str, masks, min_words: int, least: int,
            percent: int) -> Iterator[SimpleNamespace]:
    """Index the test items block by block; equal items are one before, under their smallest id."""
    rows, size = [], 0
    plain = F.array_join(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " ")
    items = (benchmark.where(f"{text} is not null and {key} is not null")
             .select(F.col(key).cast("long").alias("id"), plain.alias("words")).where("words <> ''")
             .groupBy("words").agg(F.min("id").alias("id")).select("id", "words"))
    for r in items.orderBy("id", "words").toLocalIterator():
        n = len(r[1].split())
        if rows and size + n > BLOCK_WORDS:
            yield index_items(rows, masks, min_words, least, percent)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    if rows:
        yield index_items(rows, masks, min_words, least, percent)


def _overlaps(items, least: int, percent: int):
    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            for a, _, w in W.runs(batch.column(1), fold=True):
                for (doc, item), best in sorted(_matches(w, items.value, least, percent).items()):
                    out.append((ids[a + doc].as_py(), int(items.value.ids[item]), *best))
            if out:
                names = [f.split()[0] for f in _OUT.split(", ")]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return overlaps


def _clean(items, text: str, least: int, percent: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, _, w in W.runs(batch.column(text), fold=True):
                for doc, _ in _matches(w, items.value, least, percent):
                    keep[a + doc] = False
            yield batch.filter(pa.array(keep))

    return clean


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
             item_key: str = "item_id", item_text: str = "text", masks=MASKS, min_words: int = 1,
             least: int = 13, percent: int = 80) -> DataFrame:
    """Documents that hold a test item: one row per row of ``docs`` and item, with its best overlap.

    Words are runs of bytes other than space and U+0009 to U+000D, A-Z lower-cased. A stretch of a
    diagonal is an overlap when at least ``percent`` of its words are equal and these are ``least``
    words, or ``percent`` of a shorter item. Of a diagonal's overlaps the best counts 1 for each equal
    word and -2 for each other one; of an item's diagonals the one of most equal words is shown. Null
    and empty texts overlap nothing; null items, and items below ``min_words`` words, are not looked for.
    """
    spark = docs.sparkSession
    out = None
    for items in _blocks(benchmark, item_key, item_text, masks, min_words, least, percent):
        part = docs.select(F.col(key).cast("long"), text).mapInArrow(
            _overlaps(spark.sparkContext.broadcast(items), least, percent), _OUT)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], _OUT) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", masks=MASKS, min_words: int = 1, least: int = 13,
                  percent: int = 80) -> DataFrame:
    """``docs`` without the rows that ``overlaps`` finds; columns as they are."""
    for items in _blocks(benchmark, item_key, item_text, masks, min_words, least, percent):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(items), text, least, percent),
                               docs.schema)
    return docs
