"""Typed readers with field defaults (A1-A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hlc import hlc_parse, parse_context

WRITES = ("vault_id string, ns string, fileId string, encryptedState string, blobRef string, "
          "hlcPacked string, contextPacked string, tombstone boolean, chunks array<string>, "
          "serverSeq bigint")
HISTORY = ("eventId string, vault_id string, fileId string, blobRef string, hlcPacked string, "
           "operation string, encryptedMeta string, createdAtMs bigint, serverSeq bigint, "
           "chunks array<string>")
HEADS = ("vault_id string, deviceId string, headSeq bigint, updatedAtMs bigint, "
         "frontierPacked string")
REGISTERS = "vault_id string, file_id string, payload string"


def _text(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def _chunks():
    return F.coalesce(F.col("chunks"), F.array().cast("array<string>"))


def read_writes(spark: SparkSession, path: str) -> DataFrame:
    """A1. Put items; absent refs are '', absent tombstones false, absent chunks empty."""
    raw = spark.read.schema(WRITES).json(path).withColumn("_h", hlc_parse("hlcPacked"))
    return raw.select(
        "vault_id", _text("ns").alias("ns"), F.col("fileId").alias("file_id"), "_h.ms", "_h.cnt",
        "_h.node", _text("blobRef").alias("blob_ref"), _text("encryptedState").alias("payload"),
        F.coalesce("tombstone", F.lit(False)).alias("tombstone"), _chunks().alias("chunks"),
        F.coalesce("serverSeq", F.lit(0)).alias("server_seq"),
        parse_context("contextPacked").alias("context"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A2. History events; an unknown operation reads as modify."""
    raw = spark.read.schema(HISTORY).json(path).withColumn("_h", hlc_parse("hlcPacked"))
    known = F.col("operation").isin("create", "modify", "delete", "move")
    return raw.select(
        F.col("eventId").alias("event_id"), "vault_id", F.col("fileId").alias("file_id"), "_h.ms",
        "_h.cnt", "_h.node", _text("blobRef").alias("blob_ref"),
        F.when(known, F.col("operation")).otherwise("modify").alias("op"),
        _text("encryptedMeta").alias("meta"),
        F.coalesce("createdAtMs", F.lit(0)).alias("created_ms"),
        F.coalesce("serverSeq", F.lit(0)).alias("server_seq"), _chunks().alias("chunks"))


def read_heads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A3. (heads, frontier rows); a head without frontier has no frontier row."""
    raw = spark.read.schema(HEADS).json(path)
    heads = raw.select("vault_id", F.col("deviceId").alias("device"),
                       F.coalesce("headSeq", F.lit(0)).alias("head_seq"),
                       F.coalesce("updatedAtMs", F.lit(0)).alias("updated_ms"),
                       (_text("frontierPacked") != "").alias("has_frontier"))
    rows = raw.select("vault_id", F.col("deviceId").alias("device"),
                      F.explode(parse_context("frontierPacked")).alias("node", "h"))
    return heads, rows


def read_registers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A4. (registers, skipped): rows that do not decode are skipped, not fatal."""
    from ..operators.gates import decode_records

    return decode_records(spark.read.schema(REGISTERS).json(path))
