"""Folder scans (A5) and blob inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_hidden


def scan_snapshot(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A5. Files below a folder with mtime, size and bytes; dot-segments are hidden.

    ``content`` is read only when a later step selects it.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(folder))
    base = folder.rstrip("/") + "/"
    rel = F.element_at(F.split("path", base.replace(".", "[.]"), 2), -1)
    scanned = files.select(rel.alias("path"), F.unix_millis("modificationTime").alias("mtime"),
                           F.col("length").alias("size"), "content")
    return scanned.where(~is_hidden("path"))


def blob_inventory(blobs: DataFrame, *keys: str) -> DataFrame:
    """A6. Distinct blob ids per store (or per given keys)."""
    return blobs.select(*(keys or ("store",)), "blob_id").distinct()
