"""MinHash near duplicates by an LSH forest: sorted orders of signatures, depth that adapts to a region.

Every tree of the forest sorts the documents by a string of its own minhashes. Documents that share a
beginning of ``depth`` minhashes form a region; two sets of similarity t meet in one of the trees but for a
chance of ``(1 - t**depth)**trees``, about 1e-10 at every level below. In each region

1. every document is compared with its neighbour of longest common prefix in the sorted order and with the
   region's smallest document, which joins near copies for two pairs a member;
2. regions that still hold several components compare across components by their signatures, as long as that is
   a bounded number of comparisons for each member; pairs whose minhashes agree often enough are candidates;
3. members of a region that is denser than that move to a deeper level, with more minhashes to agree on and
   more trees to keep the chance. The last level compares whatever is left.

So nothing is capped: depth grows where many unlike documents stand close together, and no pair is lost but by
the stated chance. Links are confirmed on whole sets. Equal sets are one node from the start. Sorted orders are
dealt by ranges, region sizes and smallest members are combined aggregates, and singletons, which are most rows,
leave after them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import among, discard, stored
from .components import components

#: (depth of a region, trees, minhashes a tree is sorted by) of each level, for a similarity of 0.85.
LEVELS = ((3, 24, 11), (9, 84, 11))
#: A region is compared across components up to so many pairs for each member.
PAIRS_PER_MEMBER = 256
#: Pairs across components are screened by so many minhashes, in cells of about so many rows a side.
COMPARED, CELL_ROWS = 256, 512
#: Sets of up to so many shingles are compared there whole.
SMALL = 256
#: Sets are handed on in groups of so many bytes.
GROUP_BYTES = 4 << 20


def sets(w: W.Words, k: int) -> list[np.ndarray]:
    """The sorted distinct ``k``-word shingle hashes of each text; a shorter text is one shingle."""
    one = W.hashes(w)
    win = W.windows(one, k)
    return [np.unique(win[a:b - k + 1]) if b - a >= k else
            W.windows(one[a:b], b - a) if b > a else np.zeros(0, np.uint64)
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]


def _functions(level: int) -> list[np.uint64]:
    _, trees, width = LEVELS[level]
    return [np.uint64(xxhash.xxh64_intdigest(f"{level}/{i}") | 1) for i in range(trees * width)]


def signatures(of: list[np.ndarray], level: int) -> np.ndarray:
    """16 bits of every minhash of the level, one row for each (non-empty) set."""
    flat = np.concatenate(of)
    starts = np.cumsum([0, *map(len, of[:-1])])
    mixed, functions = np.empty_like(flat), _functions(level)
    out = np.empty((len(of), len(functions)), np.uint16)
    for i, a in enumerate(functions):
        np.multiply(flat, a, out=mixed)
        out[:, i] = np.minimum.reduceat(mixed, starts) >> np.uint64(24)
    return out


def _signed(k: int, level: int):
    """``(doc, n, set_key, signature)`` of each text; the last two are null for an empty set."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in W.runs(batch.column(1), fold=True):
                of = sets(w, k)
                full = [s for s in of if len(s)]
                rows = iter(signatures(full, level) if full else ())
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([len(s) for s in of], pa.int32()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in of], pa.binary()),
                     pa.array([next(rows).tobytes() if len(s) else None for s in of], pa.binary())],
                    ["doc", "n", "set_key", "signature"])
                W.give_back()

    return signed


def _members(k: int):
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(docs, held):
            return pa.record_batch([pa.array(docs, pa.int64()), pa.array(held, pa.binary())], ["doc", "members"])

        for batch in batches:
            for a, b, w in W.runs(batch.column(1), fold=True):
                docs, held, size = [], [], 0
                for doc, s in zip(batch.column(0).slice(a, b - a).to_pylist(), sets(w, k)):
                    docs.append(doc)
                    held.append(s.tobytes())
                    size += len(held[-1])
                    if size > GROUP_BYTES:
                        yield rows(docs, held)
                        docs, held, size = [], [], 0
                yield rows(docs, held)
                W.give_back()

    return members


def _alike(percent: int):
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        W.give_back()

    return alike


def _neighbours(percent: int):
    """Each row of a sorted range with the row before it, where both stand in one region."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, 0, 0)
        for batch in batches:
            region, doc, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if last[0] is not None:
                region, doc, n = (np.concatenate([[x], y]) for x, y in zip(last, (region, doc, n)))
            if not len(region):
                continue
            last = (region[-1], doc[-1], n[-1])
            lo, hi = np.minimum(n[1:], n[:-1]).astype(np.int64), np.maximum(n[1:], n[:-1]).astype(np.int64)
            at = np.flatnonzero((region[1:] == region[:-1]) & (100 * lo >= percent * hi))
            yield pa.record_batch([pa.array(np.minimum(doc[at], doc[at + 1]), pa.int64()),
                                   pa.array(np.maximum(doc[at], doc[at + 1]), pa.int64())], ["a", "b"])

    return neighbours


def _confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are similar enough."""
    need = stored(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "need", (pairs,))
    of = stored(among(need, "doc")(docs).select("doc", "text")
                .mapInArrow(_members(k), "doc long, members binary"), "sets")
    a, b = (of.select(F.col("doc").alias(x), F.col("members").alias(f"members_{x}")) for x in "ab")
    found = stored(pairs.join(a, "a").join(b, "b").select("a", "b", "members_a", "members_b")
                   .mapInArrow(_alike(percent), "a long, b long"), "found", (of,))
    discard(need, of)
    return found


def _regions(nodes: DataFrame, level: int) -> DataFrame:
    """``(region, sorted_by, doc, n, lead, lead_n)`` of every document in a region of two or more."""
    depth, trees, width = LEVELS[level]
    rows = (nodes.select("doc", "n", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
            .select("doc", "n", "tree", F.expr(f"substring(signature, tree * {2 * width} + 1, {2 * width})").alias("key"))
            .select(F.xxhash64("tree", F.expr(f"substring(key, 1, {2 * depth})")).alias("region"),
                    F.expr(f"substring(key, {2 * depth + 1}, {2 * (width - depth)})").alias("sorted_by"), "doc", "n"))
    many = (rows.groupBy("region").agg(F.min("doc").alias("lead"), F.max("doc").alias("top"))
            .where("lead < top").select("region", "lead"))
    return rows.join(many, "region")


def _screened(percent: int, compared: int):
    """Pairs of a cell's rows with its others, in different components, that may be similar enough.

    Rows come sorted by cell: ``(region, i, j, other, doc, n, component, largest, signature, members)``. A pair is
    left out if its agreeing minhashes fall six standard deviations short of what the threshold makes expect, or
    if both sets are small enough to be here whole and show that they differ.
    """
    t = percent / 100
    need = compared * t - 6 * (compared * t * (1 - t)) ** .5

    def pairs(cell):
        _, _, _, other, doc, n, component, largest, sign, members = cell
        whole = {}

        def close(a, b):
            if members[a] is None or members[b] is None:
                return True
            for x in (a, b):
                if x not in whole:
                    whole[x] = frozenset(np.frombuffer(members[x], np.uint64).tolist())
            both = len(whole[a] & whole[b])
            return 100 * both >= percent * (len(whole[a]) + len(whole[b]) - both)

        x, y = np.flatnonzero(other == 0), np.flatnonzero(other)
        if not len(x) or not len(y):
            return
        for part in np.array_split(x, -(-len(x) * len(y) // 65536)):  # a few MB at a time
            fits = ((component[part][:, None] != component[y])
                    & ((component[part] == largest[part])[:, None] | (doc[part][:, None] < doc[y]))
                    & (100 * np.minimum(n[part][:, None], n[y]) >= percent * np.maximum(n[part][:, None], n[y])))
            p, q = np.nonzero(fits)
            p, q = part[p], y[q]
            for at in range(0, len(p), 8192):
                a, b = p[at:at + 8192], q[at:at + 8192]
                ok = np.flatnonzero((sign[a] == sign[b]).sum(1) >= need)
                ok = [x for x in ok if close(a[x], b[x])]
                if ok:
                    a, b = doc[a[ok]], doc[b[ok]]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(8)]
            columns.append(np.frombuffer(b"".join(x.as_buffer() for x in batch.column(8)), np.uint16)
                           .reshape(-1, compared))
            columns.append(np.array([*batch.column(9).to_pylist(), None], object)[:-1])
            rows = columns if held is None else [np.concatenate(c) for c in zip(held, columns)]
            new = np.zeros(len(rows[0]), bool)
            for c in rows[:3]:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                yield from pairs([c[lo:hi] for c in rows])
            held = [c[cuts[-1]:] for c in rows]
        if held is not None:
            yield from pairs(held)
        W.give_back()

    return screened


def _split(rows: DataFrame, labels: DataFrame, level: int) -> DataFrame:
    """The rows of regions with several components: ``(region, doc, n, component, largest, dense, i_n, j_n)``."""
    last = level == len(LEVELS) - 1
    named = (rows.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left")
             .select("region", "doc", "n", F.coalesce("component", "doc").alias("component")))
    sizes = named.groupBy("region", "component").agg(F.count("*").alias("c"))
    regions = sizes.groupBy("region").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("squares"),
                                          F.max(F.struct("c", "component")).alias("top"))
    dense = F.lit(False) if last else (F.col("m") * F.col("m") - F.col("squares")) / 2 > PAIRS_PER_MEMBER * F.col("m")
    return stored(named.join(regions.where(F.col("top.c") < F.col("m")).select(
        "region", F.col("top.component").alias("largest"), dense.alias("dense"),
        F.ceil(F.col("m") / CELL_ROWS).alias("i_n"), F.ceil((F.col("m") - F.col("top.c")) / CELL_ROWS).alias("j_n")),
        "region"), "across", (rows,))


def _across(rows: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, level: int, percent: int) -> DataFrame:
    """Pairs across the components of regions that are not too dense.

    ``rows`` are those of `_split`. A region's members meet those outside its largest component, in cells of
    bounded size, by the signatures of ``nodes`` and, where they are small, by their sets.
    """
    compared = min(COMPARED, LEVELS[level][1] * LEVELS[level][2])
    of = rows.where("not dense")
    here = stored(of.groupBy("doc").agg(F.min("n").alias("least")), "here", (rows,))
    among_here = among(here, "doc")
    sketch = (among_here(nodes.select("doc", F.substring("signature", 1, 2 * compared).alias("signature")))
              .join(among_here(docs).join(here.where(F.col("least") <= SMALL).select("doc"), "doc", "left_semi")
                    .mapInArrow(_members(k), "doc long, members binary").repartition("doc")
                    .dropDuplicates(["doc", "members"]), "doc", "left"))
    some = of.join(stored(sketch, "sketch", (nodes,)), "doc")
    cell = F.pmod(F.xxhash64("doc"), F.col("i_n")), F.pmod(F.xxhash64("doc"), F.col("j_n"))
    columns = ["region", "i", "j", "other", "doc", "n", "component", "largest", "signature", "members"]
    members = (some.select("*", cell[0].alias("i"), F.explode(F.sequence(F.lit(0), F.col("j_n") - 1)).alias("j"),
                           F.lit(0).alias("other")).select(*columns))
    others = (some.where("component != largest")
              .select("*", F.explode(F.sequence(F.lit(0), F.col("i_n") - 1)).alias("i"), cell[1].alias("j"),
                      F.lit(1).alias("other")).select(*columns))
    pairs = (members.union(others).repartition("region", "i", "j").sortWithinPartitions("region", "i", "j")
             .mapInArrow(_screened(percent, compared), "a long, b long").distinct())
    return pairs


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5,
                    percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    A-Z are lower-cased; a set holds the distinct ``k``-word shingles, or the whole word sequence of a
    shorter text. Documents link when ``100 * common >= percent * union`` (the forest is made for 85 or more);
    the component is the smallest id reachable by links, the document's own included, and that one is kept.
    Empty and null texts have an empty set and stay alone. Rows that share an id are one document with the
    links of all of them; a null id has no component, and whether it is kept is null. Texts of any length are
    read whole. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    signed = "doc long, n int, set_key binary, signature binary"
    feat = stored(docs.mapInArrow(_signed(k, 0), signed), "signed")
    known = feat.where("n > 0 and doc is not null")
    reps = known.groupBy("set_key").agg(F.min("doc").alias("rep"))
    of = stored(known.select("doc", "set_key").join(reps, "set_key"), "of", (feat,))
    several = of.groupBy("doc").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    links = stored(of.join(several, "doc").select(F.col("low").alias("a"), F.col("rep").alias("b"))
                   .where("a < b").distinct(), "links", (of,))
    labels = None
    heads = of.where("doc = rep").select("doc", "set_key")

    def headed(of_level):
        """Those of the signed rows that stand for a set, each once."""
        return of_level.join(heads, ["doc", "set_key"], "left_semi").dropDuplicates(["doc", "set_key"])

    def grown(links, labels, pairs, source):
        """Links and labels after the pairs were confirmed; both stay as they are if no link is new."""
        pairs = stored(pairs, "pairs", (source,))
        found = None if pairs.isEmpty() else _confirmed(docs, pairs, k, percent)
        if found is None or found.isEmpty():
            return links, components(links) if labels is None else labels
        more = stored(links.union(found), "links", (links, found))
        discard(pairs, found, links, *([labels] if labels is not None else []))
        return more, components(more)

    nodes = stored(headed(known), "nodes", (feat,))
    for level in range(len(LEVELS)):
        rows = stored(_regions(nodes, level), "regions", (nodes,))
        near = (rows.repartitionByRange("region", "sorted_by", "doc").sortWithinPartitions("region", "sorted_by", "doc")
                .select("region", "doc", "n").mapInArrow(_neighbours(percent), "a long, b long"))
        star = rows.where("lead < doc").select(F.col("lead").alias("a"), F.col("doc").alias("b"))
        links, labels = grown(links, labels, near.where("a < b").union(star).distinct(), rows)
        split = _split(rows, labels, level)
        deeper = stored(split.where("dense").select("doc").distinct(), "dense", (split,))
        links, labels = grown(links, labels, _across(split, nodes, docs, k, level, percent), rows)
        discard(rows, split)
        if deeper.isEmpty():
            discard(deeper, nodes)
            break
        above, nodes = nodes, stored(headed(
            among(deeper, "doc")(docs).join(deeper, "doc", "left_semi").mapInArrow(_signed(k, level + 1), signed)),
            "nodes", (nodes, deeper))
        discard(above)
    whole = of.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "doc", F.coalesce("component", "rep").alias("component")).groupBy("doc").agg(
        F.min("component").alias("component"))
    return feat.select("doc", "n").join(whole, "doc", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component", "doc").alias("component_id")).withColumn("kept", F.expr("doc_id = component_id"))
