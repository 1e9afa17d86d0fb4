"""Hybrid logical clocks as columns: (ms, cnt, node) in three plain columns or one struct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HLC_SCHEMA = "struct<ms:bigint,cnt:bigint,node:string>"
PACKED = r"^(\d+)-(\d+)-(.*)$"


def stamp(ms: str = "ms", cnt: str = "cnt") -> Column:
    """The part of an HLC that is compared within one node."""
    return F.struct(F.col(ms).cast("long").alias("ms"), F.col(cnt).cast("long").alias("cnt"))


def hlc(ms: str = "ms", cnt: str = "cnt", node: str = "node") -> Column:
    """Full HLC; Spark compares structs field by field, which is the HLC order."""
    return F.struct(F.col(ms).cast("long").alias("ms"), F.col(cnt).cast("long").alias("cnt"),
                    F.col(node).alias("node"))


def hlc_parse(packed: str | Column) -> Column:
    """Packed ``<ms>-<cnt>-<node>`` to a struct; null when it does not match."""
    col = F.col(packed) if isinstance(packed, str) else packed
    parsed = F.struct(
        F.regexp_extract(col, PACKED, 1).cast("long").alias("ms"),
        F.regexp_extract(col, PACKED, 2).cast("long").alias("cnt"),
        F.regexp_extract(col, PACKED, 3).alias("node"))
    return F.when(col.rlike(PACKED), parsed)


def hlc_pack(h: str | Column) -> Column:
    """Struct to a zero-padded string whose text order is the HLC order."""
    col = F.col(h) if isinstance(h, str) else h
    return F.concat_ws("-", F.lpad(col["ms"].cast("string"), 15, "0"),
                       F.lpad(col["cnt"].cast("string"), 6, "0"), col["node"])


def explode_context(df: DataFrame, context: str, keep: Sequence[str]) -> DataFrame:
    """Context map ``node -> (ms, cnt)`` to rows ``(*keep, node, h)``; empty gives no row."""
    entries = F.explode(F.col(context)).alias("node", "h")
    return df.where(F.size(context) > 0).select(*keep, entries)


def parse_context(packed: str | Column) -> Column:
    """Packed context ``node=ms-cnt;node=ms-cnt`` to a map; empty text is an empty map."""
    col = F.col(packed) if isinstance(packed, str) else packed
    parts = F.filter(F.split(F.coalesce(col, F.lit("")), ";"), lambda p: p.contains("="))
    entry = lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("key"),
        F.struct(
            F.substring_index(F.substring_index(p, "=", -1), "-", 1).cast("long").alias("ms"),
            F.substring_index(F.substring_index(p, "=", -1), "-", -1).cast("long").alias("cnt"),
        ).alias("value"))
    return F.map_from_entries(F.transform(parts, entry))
