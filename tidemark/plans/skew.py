"""Attach per-key values to rows; on request, with hot keys spread by a salt."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

HOT_KEYS = 256
SALTS = 64
SMALL_ROWS = 100_000


def hot_keys(rows: DataFrame, keys: Sequence[str], limit: int, least: int) -> list[Row]:
    """The at most ``limit`` most frequent keys with more than ``least`` rows.

    One map-side combined count; never more than ``limit`` keys reach the driver.
    """
    n = F.count(F.lit(1)).alias("_n")
    return (rows.groupBy(*keys).agg(n).where(F.col("_n") > least)
            .orderBy(F.desc("_n"), *keys).limit(limit).select(*keys).collect())


def attach(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], limit: int = HOT_KEYS,
           least: int | None = None) -> DataFrame:
    """Left join of ``rows`` with ``lookup``, which holds at most one row per key.

    By default this is a plain join, which starts no job: AQE splits its skewed partitions. With
    ``least``, keys of more rows than that are looked for first; if there are any, the lookup
    rows of the hot keys (no more than ``limit``) are broadcast; rows of hot keys carry
    their values already and are spread by a salt in the shuffle join that serves all other
    keys, each of which is either small or holds less than ``1 / limit`` of the rows.
    """
    keys = list(keys)
    payload = [c for c in lookup.columns if c not in keys]
    found = [] if least is None else hot_keys(rows, keys, limit, least)
    if not found:
        return rows.join(lookup, keys, "left").select(*rows.columns, *payload)
    hot = rows.sparkSession.createDataFrame(found, rows.select(*keys).schema)
    hot_lookup = lookup.join(F.broadcast(hot), keys, "left_semi").select(
        *keys, F.struct(*payload).alias("_hot"))
    unmatched = reduce(or_, [F.col(k).isNull() for k in keys])
    spread_rows = rows.join(F.broadcast(hot_lookup), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull() | unmatched, 1 + _salt(rows)).otherwise(F.lit(0)))
    cold = lookup.select(*keys, F.lit(0).cast("long").alias("_salt"),
                         F.struct(*payload).alias("_cold"))
    joined = spread_rows.join(cold, [*keys, "_salt"], "left")
    value = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[value[c].alias(c) for c in payload])


def flag(rows: DataFrame, known: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """``rows`` with whether their key occurs in ``known``."""
    marks = known.select(*keys).distinct().withColumn(out, F.lit(True))
    return attach(rows, marks, keys).withColumn(out, F.coalesce(out, F.lit(False)))


def keep_known(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Semi join for rows whose keys may be hot: a left join, whose skewed partitions AQE splits."""
    return flag(rows, known, keys, "_known").where("_known").drop("_known")


def drop_known(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anti join for rows whose keys may be hot: a left join, whose skewed partitions AQE splits."""
    return flag(rows, known, keys, "_known").where("not _known").drop("_known")


def attach_small(rows: DataFrame, lookup: DataFrame, keys: Sequence[str],
                 max_rows: int = SMALL_ROWS) -> DataFrame:
    """``attach`` for a lookup that is usually small, such as a catalogue.

    Its rows are counted first, up to the bound. Within it the lookup is broadcast, which
    leaves ``rows`` where they are; beyond it the shuffle join of ``attach`` takes over.
    """
    held = lookup.persist()
    if held.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(held), list(keys), "left").select(
            *rows.columns, *[c for c in lookup.columns if c not in keys])
    return attach(rows, held, keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan of fewer files than the cluster has cores more tasks.

    Costly per-row work over a handful of files would otherwise run in as many tasks. Large
    inputs, and frames that are no plain scan, pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 0 < len(df.inputFiles()) < cores:
        return df.repartition(cores, *keys)
    return df


def _salt(rows: DataFrame) -> Column:
    """Spread rows over the salts, identical copies too: they differ in input partition.

    Both parts come out the same when a lost task runs again.
    """
    plain = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*plain) + F.spark_partition_id(), F.lit(SALTS))
