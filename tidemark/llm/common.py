"""Shared folders and stored tables of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: The word separators of every word rule: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A small stored table is written by a task for each so many bytes of its inputs, but at least so many tasks.
PART_BYTES, LEAST_PARTS = 1 << 20, 24
#: Bits of `among` for each id, places of an id, and bits in all (16 MB); for more ids rows are joined instead.
ID_BITS, ID_PLACES, MOST_BITS = 16, 4, 1 << 27
#: Up to so many ids are read by one task there, which spares a shuffle.
ONE_TASK = 100_000
#: Folders made by this process that `release` may remove.
_WORK: set[str] = set()


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def scratch(spark: SparkSession, label: str, work: bool = True) -> str:
    """A new folder below the shared checkpoint folder.

    It is removed when the session's JVM ends, or by `release` if it is a ``work`` folder.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/llm-{label}-{uuid.uuid4().hex}"
    system, path = _path(spark, folder)
    system.deleteOnExit(path)
    if work:
        _WORK.add(folder)
    return folder


def stored(df: DataFrame, label: str, of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Several later steps read it, each only the columns it needs; a lost executor costs nothing
    that was written. ``of`` are stored tables that tell how large ``df`` may be: if they are small, partitions are
    joined to tasks of more rows when written, instead of a file of a few rows for each.
    """
    if of:
        df = df.coalesce(max(LEAST_PARTS, -(-sum(map(stored_bytes, of)) // PART_BYTES)))
    folder = scratch(df.sparkSession, label)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.stored_in = folder
    return out


def stored_bytes(t: DataFrame) -> int:
    """Bytes of a table of `stored`."""
    system, path = _path(t.sparkSession, t.stored_in)
    return system.getContentSummary(path).getLength()


def discard(*tables: DataFrame) -> None:
    """Remove tables of `stored` that no later step reads."""
    for t in tables:
        _remove(t.sparkSession, t.stored_in)


def work_folders() -> set[str]:
    """The work folders there are."""
    return set(_WORK)


def release(spark: SparkSession, folders) -> None:
    """Remove work folders; for a caller that has written every result that reads them."""
    for folder in list(folders):
        _remove(spark, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    system, path = _path(spark, folder)
    system.delete(path, True)
    _WORK.discard(folder)


def among(ids: DataFrame, key: str) -> Callable[[DataFrame], DataFrame]:
    """Takes from a table the rows whose ``key`` is in ``ids``, a stored table of distinct long ``key``, and few others.

    Rows stay where they are, also with millions of ids, as a Bloom filter of the ids is broadcast: about one in
    400 of the other rows passes too, so a caller that minds them joins what is left. Null keys never pass.
    """
    n = ids.count()
    if n * ID_BITS > MOST_BITS:
        return lambda df: df.join(ids.select(key), key, "left_semi")
    bits, low = max(64, n * ID_BITS), F.lit(0xFFFFFFFF).cast("long")
    h = F.xxhash64(key)
    place = F.explode(F.array(*[(h.bitwiseAND(low) + F.lit(i).cast("long") * F.shiftrightunsigned(h, 32)) % F.lit(bits)
                                for i in range(ID_PLACES)])).alias("place")
    placed = ids.where(F.col(key).isNotNull()).select(place)
    found = ((placed.coalesce(1) if n <= ONE_TASK else placed).groupBy(F.shiftright("place", 6).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits")).toArrow())
    words = np.zeros(-(-bits // 64), np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    held = ids.sparkSession.sparkContext.broadcast(words)

    def passes(hashed: pa.Array) -> pa.Array:
        x = hashed.to_numpy(zero_copy_only=False).view(np.uint64)
        one, step = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
        out = np.ones(len(x), bool)
        for i in range(ID_PLACES):
            at = (one + np.uint64(i) * step) % np.uint64(bits)
            out &= (held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pa.array(out)

    passes.__annotations__ = {"hashed": pa.Array, "return": pa.Array}
    return lambda df: df.where(F.col(key).isNotNull()).where(F.arrow_udf(passes, "boolean")(h))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows."""
    return df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)
