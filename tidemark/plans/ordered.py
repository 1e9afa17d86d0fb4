"""Running aggregates that survive a hot key.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, which is right while the
whole input is small. Beyond that ``cut`` looks where the rows lie on the order axis and sets
cuts with about as many rows between any two. Rows are windowed inside ``(key, piece)``; each
piece starts with one row that carries the total of the key's earlier pieces. As a piece holds a
bounded share of all rows, so does each ``(key, piece)``, however the rows of a key are spread.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_BYTES = 32 << 20  # Spark's estimate up to which an input is not cut; the result is the same
PIECE_ROWS = 1 << 20  # rows aimed at between two cuts
MOST_PIECES = 1 << 12


@dataclass(frozen=True)
class Running:
    """One running output: ``kind`` is count, sum, max or min over rows up to this one.

    ``before=True`` leaves the current row out of the frame.
    """

    out: str
    kind: str
    value: Column | None = None
    before: bool = False


_FOLD = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}


def _estimate(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def cut(df: DataFrame, axis: str | Column, width: int | None = None) -> Column | None:
    """Piece of a row by its place on ``axis``, a whole number that never decreases along the order.

    None for an input small enough to be windowed as it is, or too short to cut. Otherwise one job takes the quantiles
    of the axis over all rows; they become constants of the plan, so every use of the
    column and every retried task deals rows alike. Null places belong to the first piece; rows of one key
    that share one place stay together. With a ``width``, pieces are stretches of the axis of that width, for any input
    and without a job.
    """
    place = (F.col(axis) if isinstance(axis, str) else axis).cast("long")
    if width is not None:
        return F.coalesce(place - F.pmod(place, F.lit(width)), F.lit(-1 << 63))
    if _estimate(df) <= SMALL_BYTES:
        return None
    steps = [i / MOST_PIECES for i in range(1, MOST_PIECES)]
    n, at = df.agg(F.count(F.lit(1)), F.percentile_approx(place, steps, 16 * MOST_PIECES)).first()
    pieces = min(MOST_PIECES, -(-n // PIECE_ROWS))
    cuts = sorted({at[i * MOST_PIECES // pieces - 1] for i in range(1, pieces)}) if at else []
    if not cuts:
        return None
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    strides = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(strides, F.lit(0), lambda low, stride: F.when(
        F.try_element_at(table, low + stride) <= place, low + stride).otherwise(low))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], piece: Column | None,
            outputs: Sequence[Running], source: DataFrame | None = None) -> DataFrame:
    """Add running aggregates per ``keys`` in ``order``; null keys are a key like any other.

    ``piece`` (see ``cut``) must never decrease along ``order``; None windows each key at once.
    ``source`` may name a cheaper frame with the same rows for the totals of the pieces (for
    instance the scan below earlier window steps).
    """
    def stage(frame: DataFrame) -> DataFrame:
        return frame.withColumns({f"_v{i}": F.lit(1).cast("long") if o.kind == "count" else o.value
                                  for i, o in enumerate(outputs)})

    def scan(frame: DataFrame, inside) -> DataFrame:
        frames = [inside.rowsBetween(Window.unboundedPreceding, -1 if o.before else 0) for o in outputs]
        done = {f"_l{i}": _FOLD[o.kind](f"_v{i}").over(frames[i]) for i, o in enumerate(outputs)}
        return frame.withColumns({
            name: F.coalesce(value, F.lit(0)) if o.kind in ("count", "sum") else value
            for (name, value), o in zip(done.items(), outputs)})

    kept = [c for c in df.columns if c not in {o.out for o in outputs}]
    plain = scan(stage(df), Window.partitionBy(*keys).orderBy(*order))
    if piece is None:
        return plain.select(*kept, *[F.col(f"_l{i}").alias(o.out) for i, o in enumerate(outputs)])

    staged = stage(df).withColumn("_b", piece)
    totals = (staged if source is None else stage(source).withColumn("_b", piece)).groupBy(*keys, "_b").agg(
        *[_FOLD[o.kind](f"_v{i}").alias(f"_v{i}") for i, o in enumerate(outputs)])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_b", F.lit(0).alias("_own"), F.row_number().over(earlier.rowsBetween(
            Window.unboundedPreceding, 0)).alias("_i"),
        *[_FOLD[o.kind](f"_v{i}").over(earlier).alias(f"_v{i}") for i, o in enumerate(outputs)]
    ).where("_i > 1").drop("_i")
    both = staged.withColumn("_own", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    scanned = scan(both, Window.partitionBy(*keys, "_b").orderBy("_own", *order)).where("_own = 1")
    return scanned.select(*kept, *[F.col(f"_l{i}").cast(plain.schema[f"_l{i}"].dataType).alias(o.out)
                                   for i, o in enumerate(outputs)])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                piece: Column | None, out: str, source: DataFrame | None = None) -> DataFrame:
    """1-based position per key, exact, without gathering a key of a large input in one task."""
    return running(df, keys, order, piece, [Running(out, "count")], source)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row per key. Spark limits each key before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def text_axis(col: str | Column, chars: int = 7) -> Column:
    """Place of a text on an axis by its first bytes (at most seven); monotone in byte order."""
    c = F.col(col) if isinstance(col, str) else col
    raw = F.rpad(F.substring(F.hex(F.encode(c, "UTF-8")), 1, 2 * chars), 2 * chars, "0")
    return F.conv(raw, 16, 10).cast("long")
