"""Hard negatives from Hilbert-ordered Parquet blocks with zone maps.

Rows are sorted along a Hilbert curve through the leading axes of the vectors and written as Parquet files whose
row groups are the blocks. A block's zone map holds the least and largest value of every dimension, in the axes'
coordinates; interval arithmetic bounds from it what score a row of the block can have with an anchor. An anchor
has to read a block only if that interval meets one of its windows: at least its fifth best positive so far, or
between 80 % of a positive's score and that score, above its fifth best negative there so far.

* The axes are those of the covariance over all rows, a sum of 64 x 64 cells; nothing is sampled.
* A strip is the file of one range of the curve; its anchors are a file too. A tile is the anchors of one span of
  strips with the blocks of another; its task reads row groups by ranges, keeping one block and the anchors' best rows
  at a time. Tiles of a span with its own anchors come first, so that all other tiles start with good thresholds.
* Anchors and candidates meet only in tiles; what moves between tasks are best rows, at most five for a window and
  tile. Blocks are read from the shared folder, so a lost task is simply run again. Files have names of their own,
  and only files named in the index are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored
from .files import open_fs, put
from .words import give_back

#: Rows of a block, and leading axes of the curve with bits for each.
BLOCK_ROWS, AXES, BITS = 256, 8, 7
#: Bytes of vectors in a strip: at most the first, and no fewer than the second to have a strip for every core.
STRIP_BYTES, LEAST_BYTES = 64 << 20, 2 << 20
POSITIVES = NEGATIVES = 5
_LOW, _HIGH = 80, 100
#: Scores are sums of exact doubles up to here; beyond, Python's integers are used.
_EXACT = 1 << 53
_FAR = -(1 << 62)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of points (rows of unsigned cells, fewer than 64 bits in all) along a Hilbert curve.

    By transposing: undo the excess rotations from the highest bit down, then Gray-decode.
    """
    x = points.astype(np.uint64).T.copy()
    one, n = np.uint64(1), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            high = (x[i] & np.uint64(q)) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of whole doubles, rounded down; shorter ones are filled up with zeros."""
    flat, off = np.floor(column.values.to_numpy(zero_copy_only=False)), column.offsets.to_numpy()
    out, size = np.zeros((len(column), width)), np.diff(off)
    at = np.repeat(np.arange(len(column)), size)
    out[at, np.arange(off[0], off[-1]) - np.repeat(off[:-1], size)] = flat[off[0]:off[-1]]
    return out


def _moments(width: int):
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((width + 1, width)), 0
        for batch in batches:
            q = _matrix(batch.column(0), width)
            scale = np.maximum(np.abs(q).max(axis=1, keepdims=True, initial=0), 1)
            q = q / np.maximum(scale / 1e6, 1)  # a huge row turns the axes no more than a large one
            total[:-1] += q.T @ q
            total[-1] += q.sum(0)
            n += len(q)
        if n:
            yield pa.record_batch({"sums": pa.array([[*total.ravel().tolist(), n]], pa.list_(pa.float64()))})

    return moments


def axes(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Principal axes (columns), the mean and the spread along each axis, over all rows."""
    cells = (rows.select("q").mapInArrow(_moments(width), "sums array<double>").select(F.posexplode("sums"))
             .groupBy("pos").agg(F.sum("col").alias("sum")).collect())  # width * (width + 1) + 1 rows
    flat = np.zeros(width * (width + 1) + 1)
    for r in cells:
        flat[r.pos] = r["sum"]
    n, sums = flat[-1], flat[:-1].reshape(width + 1, width)
    mean = sums[-1] / max(n, 1)
    cov = sums[:-1] / max(n, 1) - np.outer(mean, mean)
    spread, turned = np.linalg.eigh(np.nan_to_num(cov))
    return turned[:, ::-1].copy(), mean, np.sqrt(np.maximum(spread[::-1], 1e-12))


def _keyed(width: int, frame):
    """Rows with their place on the curve."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned, mean, spread = frame.value
        lead = min(AXES, width)
        for batch in batches:
            z = (_matrix(batch.column("q"), width) - mean) @ turned[:, :lead] / (4 * spread[:lead]) if width else np.zeros(
                (batch.num_rows, 1))
            cells = np.clip((np.nan_to_num(z) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
            yield batch.append_column("place", pa.array(hilbert(cells.astype(np.uint64), BITS).astype(np.int64)))

    return keyed


_STRIP = "strip int, file string, anchors string, blocks long, rows long"  # anchors: the file, if it has any


def _strips(folder: str, width: int, frame, every: int):
    """Write one range as blocks with their zone maps, and its anchors; rows come sorted and equal rows once."""

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = frame.value[0]
        system, path = open_fs(folder)
        system.create_dir(path, recursive=True)
        name, part = uuid.uuid4().hex, TaskContext.get().partitionId()
        schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("q", pa.binary(8 * width))])
        zones, picked, held, n, last = [], [], [], 0, None
        out = system.open_output_stream(f"{path}/{name}.parquet")
        writer = pq.ParquetWriter(out, schema, compression="none", use_dictionary=False, write_statistics=False)

        def block(ids, labels, q):
            writer.write_table(pa.table([pa.array(ids), pa.array(labels), pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(8 * width), len(ids), [None, pa.py_buffer(np.ascontiguousarray(q))])], schema=schema))
            z = q @ turned
            zones.append((z.min(0), z.max(0), np.unique(labels)))
            at = np.flatnonzero(ids % every == 0)
            picked.append((ids[at], labels[at], q[at]))

        for batch in batches:
            ids, labels, q = (batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(),
                              _matrix(batch.column("q"), width))
            joined = np.concatenate([ids[:, None], labels[:, None]], 1)
            new = np.ones(len(ids), bool)
            new[1:] = (joined[1:] != joined[:-1]).any(1) | (q[1:] != q[:-1]).any(1)
            if last is not None and len(ids):
                new[0] = (joined[0] != last[0]).any() or (q[0] != last[1]).any()
            if len(ids):
                last = joined[-1], q[-1]
            held.append((ids[new], labels[new], q[new]))
            n += int(new.sum())
            while sum(len(x[0]) for x in held) >= BLOCK_ROWS:
                ids, labels, q = (np.concatenate(c) for c in zip(*held))
                block(ids[:BLOCK_ROWS], labels[:BLOCK_ROWS], q[:BLOCK_ROWS])
                held = [(ids[BLOCK_ROWS:], labels[BLOCK_ROWS:], q[BLOCK_ROWS:])]
        if held and sum(len(x[0]) for x in held):
            block(*(np.concatenate(c) for c in zip(*held)))
        writer.close()
        out.close()
        if not zones:
            return
        table = pa.table({"lo": pa.array([z[0].tolist() for z in zones], pa.list_(pa.float64())),
                          "hi": pa.array([z[1].tolist() for z in zones], pa.list_(pa.float64())),
                          "labels": pa.array([z[2].tolist() for z in zones], pa.list_(pa.int64()))})
        _write(folder, f"{name}-zones.parquet", table)
        ids, labels, q = (np.concatenate(c) for c in zip(*picked))
        _write(folder, f"{name}-anchors.parquet", pa.table(
            {"vec_id": ids, "label": labels, "q": pa.array([x.tobytes() for x in q], pa.binary())}))
        yield pa.record_batch({"strip": pa.array([part], pa.int32()), "file": [name],
                               "anchors": pa.array([name if len(ids) else None], pa.string()),
                               "blocks": pa.array([len(zones)], pa.int64()), "rows": pa.array([n], pa.int64())})
        give_back()

    return strips


def _write(folder: str, name: str, table: pa.Table) -> None:
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink)
    put(folder, name, sink.getvalue().to_pybytes())


def _read(folder: str, name: str) -> pa.Table:
    system, path = open_fs(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        return pq.read_table(f)


def _vectors(table: pa.Table, width: int) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), np.float64) for x in table["q"].combine_chunks()]).reshape(
        -1, width)


class _Blocks:
    """The blocks of one strip with their zone maps; row groups are read one at a time."""

    def __init__(self, folder: str, name: str, width: int):
        system, path = open_fs(folder)
        self.width, self.read = width, 0
        self.file = pq.ParquetFile(system.open_input_file(f"{path}/{name}.parquet"))
        zones = _read(folder, f"{name}-zones.parquet")
        self.lo, self.hi = (np.array(zones[c].to_pylist(), float).reshape(-1, width) for c in ("lo", "hi"))
        self.labels = [np.array(x, np.int64) for x in zones["labels"].to_pylist()]

    def bounds(self, anchors: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of every anchor (rows) with a row of every block (columns)."""
        a = anchors @ turned
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        slack = 1e-9 * (1 + np.abs(a) @ np.maximum(np.abs(self.lo), np.abs(self.hi)).T)  # of the turned coordinates
        return up @ self.lo.T + down @ self.hi.T - slack, up @ self.hi.T + down @ self.lo.T + slack

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, labels and vectors of a block."""
        self.read += 1
        t = self.file.read_row_group(i)
        q = np.frombuffer(t["q"].combine_chunks().buffers()[1], np.float64) if self.width else np.zeros(0)
        return t["vec_id"].to_numpy(), t["label"].to_numpy(), q[:t.num_rows * self.width].reshape(t.num_rows, -1)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; as Python's integers where doubles would not be exact."""
    size = (np.abs(a).max(initial=0) + 1) * (np.abs(b).max(initial=0) + 1) * max(a.shape[1], 1)
    if size < _EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array(
        [[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class _Best:
    """The ``k`` best (score, smaller id) rows of every slot."""

    def __init__(self, slots: int, k: int, floor: np.ndarray):
        self.score = np.full((slots, k), _FAR, np.int64)
        self.id = np.full((slots, k), np.iinfo(np.int64).max, np.int64)
        self.floor = floor.astype(np.int64)  # a score below cannot be among the best

    def need(self) -> np.ndarray:
        """The least score that may still enter each slot."""
        return np.maximum(self.floor, self.score[:, -1])

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """Rows of ``scores`` are for ``slots``, columns for ``ids``; only those ``ok`` count."""
        ok = ok & (scores >= self.need()[slots][:, None])
        hit = np.flatnonzero(ok.any(1))
        for r in hit:
            c = np.flatnonzero(ok[r])
            s, i = np.concatenate([self.score[slots[r]], scores[r, c]]), np.concatenate([self.id[slots[r]], ids[c]])
            first = np.lexsort((i, -s))[:self.score.shape[1]]
            self.score[slots[r]], self.id[slots[r]] = s[first], i[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots, scores and ids of all rows held."""
        at = self.id != np.iinfo(np.int64).max
        return np.nonzero(at)[0], self.score[at], self.id[at]


_FOUND = "span int, anchor_row int, slot int, anchor_id long, other_id long, score long, n_blocks long"


def _tiles(folder: str, width: int, frame, windows: bool):
    """Best rows of each tile ``(span, anchors, files, known)``.

    ``known`` are the thresholds of the anchors, one row each: the least score worth having, and for ``windows``
    the positives' scores. Without ``windows`` the rows are the best of the anchor's own label, slot 0; with
    them, those of other labels in the window of positive ``slot``.
    """

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = frame.value[0]
        for batch in batches:
            for span, mine, files, known in zip(*(batch.column(c).to_pylist() for c in range(4))):
                yield from tile(turned, span, mine, files, {k["row"]: k for k in known or ()})
        give_back()

    def asked(blocks, turned, best, ids, q, row, own, high):
        """Offer the rows of a file's blocks that some slot has to read; how many those are."""
        lo, hi = blocks.bounds(q, turned)
        has = {int(x): np.array([x in b for b in blocks.labels]) for x in np.unique(own)}
        other = np.array([len(b) > 1 for b in blocks.labels])
        only = np.array([b[0] for b in blocks.labels])
        for b in np.argsort(-hi.max(0), kind="stable"):  # where the highest scores may be
            fits = (hi[row, b] >= best.need()) & (lo[row, b] <= high)
            if windows:
                fits &= other[b] | (only[b] != own)
            else:
                fits &= np.array([has[x][b] for x in own.tolist()], bool)
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            theirs, kinds, vectors = blocks.block(int(b))
            rows, back = np.unique(row[at], return_inverse=True)
            scores = _scores(q[rows], vectors)[back]
            same = own[at][:, None] == kinds
            if windows:
                ok = ~same & (scores <= high[at][:, None])
            else:  # the row itself is no other row
                ok = same & ~((ids[row[at]][:, None] == theirs) & (q[rows][:, None] == vectors).all(2)[back])
            best.offer(at, scores, theirs, ok)
        return blocks.read

    def tile(turned, span, mine, files, known):
        table = pa.concat_tables([_read(folder, f"{name}-anchors.parquet") for name in mine])
        ids, labels, q = table["vec_id"].to_numpy(), table["label"].to_numpy(), _vectors(table, width)
        # A slot is an anchor, or with windows an anchor and one of its positives' scores.
        if windows:
            slots = [(r, s, top) for r, k in sorted(known.items()) for s, top in enumerate(k["tops"])]
            row = np.array([r for r, _, _ in slots], np.int64)
            number = np.array([s for _, s, _ in slots], np.int64)
            high = np.array([t for _, _, t in slots], np.int64)
            low = np.array([-(-_LOW * int(t) // _HIGH) for t in high], np.int64)
            floors = [f for _, k in sorted(known.items()) for f in (k["floors"] or [_FAR] * len(k["tops"]))]
            floor = np.maximum(low, np.array(floors, np.int64)) if slots else low
        else:
            row = np.arange(len(ids))
            number, high = np.zeros(len(ids), np.int64), np.full(len(ids), np.iinfo(np.int64).max)
            floor = np.array([known[r]["floors"][0] if r in known and known[r]["floors"] else _FAR for r in row.tolist()],
                             np.int64)
        if not len(row):
            return
        best = _Best(len(row), NEGATIVES if windows else POSITIVES, floor)
        own = labels[row]
        blocks_read = sum(asked(_Blocks(folder, name, width), turned, best, ids, q, row, own, high) for name in files)
        slot, score, found = best.rows()
        for a in range(0, len(slot), 50_000):
            s = slot[a:a + 50_000]
            yield pa.record_batch({
                "span": pa.array([span] * len(s), pa.int32()), "anchor_row": pa.array(row[s], pa.int32()),
                "slot": pa.array(number[s], pa.int32()), "anchor_id": pa.array(ids[row[s]]),
                "other_id": pa.array(found[a:a + 50_000]), "score": pa.array(score[a:a + 50_000]),
                "n_blocks": pa.array(np.full(len(s), blocks_read))})

    return tiles


def _top(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of every slot."""
    order = Window.partitionBy("span", "anchor_row", "slot").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """Blocks, zone maps and anchors of rows ``(vec_id, label, q)``, in the shared folder."""

    def __init__(self, rows: DataFrame, every: int):
        spark = rows.sparkSession
        n, self.width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
        self.folder = scratch(spark, "blocks")
        self.frame = spark.sparkContext.broadcast(axes(rows, self.width))
        size = n * 8 * max(self.width, 1)
        parts = max(1, -(-size // STRIP_BYTES), min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES))
        keyed = rows.mapInArrow(_keyed(self.width, self.frame), "vec_id long, label long, q array<double>, place long")
        self.strips = stored(
            keyed.repartitionByRange(parts, "place", "vec_id", "label", "q")
            .sortWithinPartitions("place", "vec_id", "label", "q").select("vec_id", "label", "q")
            .mapInArrow(_strips(self.folder, self.width, self.frame, every), _STRIP), "strips")
        # Spans of strips, should the cluster have dealt more strips than were asked for.
        there = (self.strips.agg(F.max("strip")).first()[0] or 0) + 1
        self.spans = min(parts, there)
        span = F.expr(f"cast(strip div {-(-there // self.spans)} as int)")
        self.files = stored(self.strips.groupBy(span.alias("span")).agg(
            F.sort_array(F.collect_list("file")).alias("files"), F.sort_array(F.collect_list("anchors")).alias("anchors")),
            "spans")

    def search(self, known: DataFrame | None, windows: bool, home: bool) -> DataFrame:
        """Best rows of the tiles on the diagonal (``home``) or of all others, with the thresholds ``known``."""
        mine = self.files.where("size(anchors) > 0").select("span", "anchors")
        if known is not None:
            mine = mine.join(known, "span", "inner" if windows else "left")
        else:
            mine = mine.withColumn("known", F.expr("cast(null as array<struct<row:int,tops:array<long>,floors:array<long>>>)"))
        others = F.sequence(F.lit(0), F.lit(self.spans - 1))
        tiles = (mine.withColumn("other", F.col("span") if home else F.explode(F.filter(others, lambda x: x != F.col("span"))))
                 .join(self.files.select(F.col("span").alias("other"), "files"), "other"))
        count = self.spans if home else self.spans * (self.spans - 1)
        return (tiles.repartition(max(1, min(count, 100_000)), "span", "other").select("span", "anchors", "files", "known")
                .mapInArrow(_tiles(self.folder, self.width, self.frame, windows), _FOUND))

    def _known(self, tops: DataFrame | None, found: DataFrame, k: int) -> DataFrame:
        """Thresholds for the tiles to come: the ``k``-th best scores there are, for each slot."""
        full = found.where(F.col("rank") == k).select("span", "anchor_row", "slot", F.col("score").alias("floor"))
        if tops is None:
            rows = full.select("span", "anchor_row", F.expr("cast(null as array<long>)").alias("tops"),
                               F.array("floor").alias("floors"))
        else:
            rows = (tops.join(full, ["span", "anchor_row", "slot"], "left")
                    .groupBy("span", "anchor_row")
                    .agg(F.sort_array(F.collect_list(F.struct("slot", "top", F.coalesce("floor", F.lit(_FAR)).alias("floor"))))
                         .alias("s"))
                    .select("span", "anchor_row", F.col("s.top").alias("tops"), F.col("s.floor").alias("floors")))
        return rows.groupBy("span").agg(F.collect_list(
            F.struct(F.col("anchor_row").alias("row"), "tops", "floors")).alias("known"))

    def best(self, tops: DataFrame | None) -> DataFrame:
        """The best rows of all anchors: positives, or with ``tops`` negatives in each positive's window."""
        windows, k = tops is not None, NEGATIVES if tops is not None else POSITIVES
        first = self._known(tops, _none(self.strips), k) if windows else None
        home = stored(_top(self.search(first, windows, True), k), "home")
        if self.spans == 1:
            return home
        rest = self.search(self._known(tops, home, k), windows, False)
        return stored(_top(home.drop("rank").unionByName(rest), k), "best")


def _none(strips: DataFrame) -> DataFrame:
    return strips.sparkSession.createDataFrame([], _FOUND + ", rank int")


def labelled(rows: DataFrame) -> DataFrame:
    """The rows of the query that take part: ``(vec_id, label, q)`` with labels moved and components in 256ths."""
    # Arrays of other number types are taken as doubles.
    vector = F.col("embedding").cast("array<double>")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return (rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
            .select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"),
                    F.transform(vector, lambda x: x * 256).alias("q")))


def mine(rows: DataFrame, every: int = 100) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` are ``(vec_id, label, q)``, components of ``q`` are rounded down; rows whose id is divisible by ``every`` are
    anchors. Rows without an id, label or vector must be left out before (`labelled` does). Rows equal in all
    three are one row; rows that share an id but differ are rows of their own, anchors included. Missing
    components of shorter vectors count as 0, so an empty vector scores 0 with any. Scores outside 64 bits stand
    at the nearest 64-bit number. An anchor without positives, or without a row in a window, gives no rows for it;
    so does an empty table. Other columns are ignored.
    """
    index = Index(rows.select("vec_id", "label", "q"), every)
    positives = index.best(None)
    tops = positives.select("span", "anchor_row", (F.col("rank") - 1).alias("slot"), F.col("score").alias("top"))
    named = positives.select("span", "anchor_row", (F.col("rank") - 1).alias("slot"),
                             F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = index.best(stored(tops, "tops"))
    return (found.select("span", "anchor_row", "slot", "anchor_id", "rank", F.col("other_id").alias("negative_id"),
                         F.col("score").alias("negative_score"))
            .join(named, ["span", "anchor_row", "slot"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


MINE_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l,
        list_transform(embedding, lambda x: floor(256 * x::double)) q from embeddings
      where label is not null and embedding is not null and vec_id is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id a, b.vec_id b, a.l = b.l same, list_dot_product(a.q, b.q)::bigint s
      from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5)
select p.a anchor_id, p.b positive_id, (row_number() over w)::int "rank", s.b negative_id, p.s positive_score,
       s.s negative_score
from p join s on s.a = p.a and not s.same and 80 * p.s <= 100 * s.s and 100 * s.s <= 100 * p.s
window w as (partition by p.a, p.b order by s.s desc, s.b) qualify row_number() over w <= 5
"""
