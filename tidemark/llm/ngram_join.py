"""N-gram Jaccard join: shingle sets that overlap by a threshold, found by prefixes of several orders.

Two sets of similarity t share an element among the first ``n - ceil(t n) + 1`` of each, whatever
global order the elements are sorted in. Candidates come from the order "rarest first", where
passages that many documents share stand last, and must also share a prefix element under two
hash orders; only then are the sets themselves compared.

* Rarity comes from a sketch of fixed size (two hash rows of 2^20 counters, 4 MB), so it can be
  broadcast whatever the corpus. Its error changes the order, the same way for all, never a result.
* How many elements two sets must share follows from their sizes, so the shared one must stand at a
  place that leaves room for the rest: a test on the two places, made before a pair is formed.
* Equal sets are one node. Documents that share a prefix element are first compared with the
  smallest of them only. What is then still in different components is compared in further rounds,
  with the next 15, 240, ... of the group; pairs already connected are left out. So a group
  of near copies costs a few rows for each of its members, and no link between components is lost.
* A document's set is built again from its text when it is compared; sets are never all shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import discard, stored
from .components import components

SKETCH_BITS = 20
_PIECE = 1 << 15
#: Documents to compare are found by a broadcast of their ids up to so many, else by a shuffle.
BROADCAST_ROWS = 500_000
_SALTS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - SKETCH_BITS)
    return (h >> shift).astype(np.int64), ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def _counts(k: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << SKETCH_BITS), np.int64)
        for batch in batches:
            for _, _, w in W.runs(batch.column(0), fold=True):
                h = W.windows(W.hashes(w), k)[W.window_starts(w, k)]
                for row, cells in enumerate(_cells(h)):
                    total[row] += np.bincount(cells, minlength=1 << SKETCH_BITS)
        if total.any():
            flat = np.minimum(total, 255).astype(np.uint8).reshape(-1, _PIECE)
            yield pa.record_batch({"piece": pa.array(range(len(flat)), pa.int32()),
                                   "counts": pa.array([x.tobytes() for x in flat], pa.binary())})
        W.give_back()

    return counts


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, piece = np.zeros(_PIECE, np.int64), None
    for batch in batches:
        piece = batch.column(0)[0]
        for x in batch.column(1):
            total += np.frombuffer(x.as_buffer(), np.uint8)
    yield pa.record_batch({"piece": pa.array([piece.as_py()], pa.int32()), "counts": pa.array(
        [np.minimum(total, 65535).astype("<u2").tobytes()], pa.binary())})


def rarity(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Counters over all shingles of the corpus: 2 rows of 2^20, 64 pieces to the driver."""
    pieces = (docs.select(text).mapInArrow(_counts(k), "piece int, counts binary")
              .groupBy("piece").applyInArrow(_add_up, "piece int, counts binary").collect())
    flat = np.zeros((2 << SKETCH_BITS) // _PIECE * _PIECE, np.uint16)
    for p in pieces:
        flat[p.piece * _PIECE:(p.piece + 1) * _PIECE] = np.frombuffer(p.counts, "<u2")
    return flat.reshape(2, -1)


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, w in W.runs(column, fold=True):
        one = W.hashes(w)
        win = W.windows(one, k)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if b - a >= k:
                yield np.unique(win[a:b - k + 1])
            else:
                yield W.windows(one[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _prefix(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _features(k: int, percent: int, counters):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = counters.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for doc, s in zip(ids, _sets(batch.column(1), k)):
                if len(s):
                    a, b = _cells(s)
                    rare = np.minimum(rows[0][a], rows[1][b])
                    first = s[np.lexsort((s, rare))[:_prefix(len(s), percent)]].view(np.int64)
                    out.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), first))
                else:
                    out.append((doc, 0, None, None))
                if len(out) == 2000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)
        W.give_back()

    def _rows(out):
        doc, n, key, first = zip(*out)
        return pa.record_batch([pa.array(doc, pa.int64()), pa.array(n, pa.int32()), pa.array(key, pa.binary()),
                                pa.array(first, pa.list_(pa.int64()))], ["doc", "n", "set_key", "first"])

    return features


def _compared(k: int, percent: int):
    """Whole sets, and their prefixes under the hash orders (as 32 bits: more may seem shared)."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, sets = batch.column(0).to_pylist(), list(_sets(batch.column(1), k))
            for a in range(0, len(doc), 200):
                part = sets[a:a + 200]
                orders = [[(o := np.argsort(s * salt)[:_prefix(len(s), percent)], s[o].astype(np.uint32)
                            .view(np.int32))[1] for s in part] for salt in _SALTS]
                yield pa.record_batch(
                    [pa.array(doc[a:a + 200], pa.int64()), *(pa.array(o, pa.list_(pa.int32())) for o in orders),
                     pa.array([s.tobytes() for s in part], pa.binary())], ["doc", "order_2", "order_3", "members"])
            del sets
            W.give_back()

    return compared


def _linked(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        W.give_back()

    return linked


def _verify(docs: DataFrame, key: str, text: str, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of ``pairs`` whose sets are similar enough."""
    need = stored(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "need")
    small = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    sets = (docs.select(F.col(key).cast("long").alias("doc"), text).join(small, "doc", "left_semi")
            .mapInArrow(_compared(k, percent), "doc long, order_2 array<int>, order_3 array<int>, members binary"))
    sets = stored(sets, "sets")

    def side(name, *columns):
        return sets.select(F.col("doc").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    orders = ("order_2", "order_3")
    alike = pairs.join(side("a", *orders), "a").join(side("b", *orders), "b")
    for o in orders:
        alike = alike.where(F.arrays_overlap(f"{o}_a", f"{o}_b"))
    alike = alike.select("a", "b").distinct()
    found = stored(alike.join(side("b", "members"), "b").join(side("a", "members"), "a")
                   .select("a", "b", "members_a", "members_b").mapInArrow(_linked(percent), "a long, b long").distinct(),
                   "found")
    discard(need, sets)
    return found


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5,
                      percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    A-Z are lower-cased; a set holds the distinct ``k``-word shingles, or the whole word sequence of
    a shorter text. Two documents link when ``100 * common >= percent * union``; the component is
    the smallest id reachable by links, the document's own included. Empty and null texts have an
    empty set and stay alone. Rows that share an id are one document with the links of all of them;
    a null id has no component. Shingles are compared by 64-bit hashes, whole sets by 128 bits.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(key, text)
    counters = spark.sparkContext.broadcast(rarity(docs, text, k))
    feat = stored(docs.select(F.col(key).cast("long"), text).mapInArrow(
        _features(k, percent, counters), "doc long, n int, set_key binary, first array<long>"), "features")
    known = feat.where("n > 0 and doc is not null")
    reps = stored(known.groupBy("set_key").agg(F.min("doc").alias("rep")), "reps")
    of = stored(known.select("doc", "set_key").join(reps, "set_key").select("doc", "rep"), "of")
    lowest = of.groupBy("doc").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    links = of.join(lowest, "doc").select(F.col("low").alias("a"), F.col("rep").alias("b")).where("a < b").distinct()

    by_token = Window.partitionBy("token").orderBy("doc")
    ranked = (known.join(reps.select(F.col("rep").alias("doc"), "set_key"), ["doc", "set_key"], "left_semi")
              .select("doc", "n", F.posexplode("first").alias("at", "token"))
              .select("token", "doc", "n", "at", F.first("doc").over(by_token).alias("lead"),
                      F.first("n").over(by_token).alias("lead_n"), F.first("at").over(by_token).alias("lead_at"),
                      F.dense_rank().over(by_token).alias("place")))
    groups = stored(ranked.where("place > 1"), "groups")

    def near(n, at, m, other_at):
        """Sets of n and m must share so many elements, so one among the first of each that may be missed."""
        least = F.ceil(percent * (F.col(n) + F.col(m)) / (100 + percent))
        return (F.col(at) <= F.col(n) - least) & (F.col(other_at) <= F.col(m) - least)

    pairs = (groups.where(near("n", "at", "lead_n", "lead_at"))
             .select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct())
    done, up_to, labels = 1, 1, None
    while True:
        pairs = stored(pairs, "pairs")
        found = _verify(docs, key, text, pairs, k, percent)
        old, links = (links, labels), stored(links.union(found), "linked")
        discard(pairs, found, *(x for x in old if hasattr(x, "stored_in")))
        labels = components(links)
        done, up_to = up_to, up_to * 16
        left = (groups.where(F.col("place") > done)
                .join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left")
                .select("token", "doc", "n", "at", "place", F.coalesce("component", "doc").alias("component")))
        split = (left.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                 .where("low < high").select("token"))
        left = stored(left.join(split, "token", "left_semi"), "left")
        if left.isEmpty():
            discard(left, groups, links)
            break
        lead = left.where(F.col("place") <= up_to).select(
            "token", F.col("doc").alias("a"), F.col("n").alias("a_n"), F.col("at").alias("a_at"),
            F.col("place").alias("a_place"), F.col("component").alias("a_component"))
        pairs = (left.join(lead, "token").where((F.col("place") > F.col("a_place"))
                                                & (F.col("component") != F.col("a_component"))
                                                & near("n", "at", "a_n", "a_at"))
                 .select("a", F.col("doc").alias("b")).distinct())
    whole = of.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "doc", F.coalesce("component", "rep").alias("component")).groupBy("doc").agg(
        F.min("component").alias("component"))
    return feat.select("doc", "n").join(whole, "doc", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component", "doc").alias("component_id"))
