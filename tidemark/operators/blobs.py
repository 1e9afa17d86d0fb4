"""Blob presence, healing, chunking, manifests and dedup."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cdc import cut_points
from ..plans.ordered import cut, number_rows, text_axis
from ..plans.skew import attach, drop_known, flag, spread
from .causal import FILE, live_refs

#: A blob belongs to its vault's collection.
BLOB = ["vault_id", "blob_id"]
CHUNK_MIN, CHUNK_AVG, CHUNK_MAX = 512 << 10, 1 << 20, 4 << 20
FLUSH_BYTES = 32 << 20
CHUNK_COLUMNS = ["file_id", "ord", "off", "size", "hash", "bytes"]
CHUNK_SCHEMA = "file_id string, ord bigint, off bigint, size bigint, hash string, bytes binary"


def blobs_exist(ids: DataFrame, blobs: DataFrame) -> DataFrame:
    """J1. Requested ids ``(vault_id, blob_id)`` that their vault stores."""
    return ids.select(*BLOB).distinct().join(blobs.select(*BLOB).distinct(), BLOB, "left_semi")


def upload_plan(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """J2. Refs not stored yet, each once."""
    return wanted.select("ref").distinct().join(known.select("ref").distinct(), "ref", "left_anti")


def known_chunks(records: DataFrame, keys: tuple[str, ...] = ("vault_id",)) -> DataFrame:
    """J3. Chunks any value references; a live value without chunks counts as its own ref."""
    bare = F.when((F.size("chunks") == 0) & ~F.col("tombstone") & (F.col("blob_ref") != ""),
                  F.array("blob_ref")).otherwise(F.col("chunks"))
    return records.select(*keys, F.explode(bare).alias("ref")).distinct()


REF = ["vault_id", "ref"]


def _refs(blobs: DataFrame) -> DataFrame:
    return blobs.select("vault_id", F.col("blob_id").alias("ref"))


def prefetch_plan(records: DataFrame, cache: DataFrame, batch: int = 8) -> DataFrame:
    """J4. Distinct live manifests missing in their vault's cache, in numbered batches per vault."""
    refs = records.where(~F.col("tombstone") & (F.col("blob_ref") != "")).select(
        "vault_id", F.col("blob_ref").alias("ref")).distinct()
    missing = drop_known(refs, _refs(cache), REF)
    numbered = number_rows(missing, ["vault_id"], ["ref"], cut(refs, text_axis("ref")), "_n")
    return numbered.select("vault_id", "ref",
                           F.expr(f"(_n - 1) div {batch}").alias("batch_no"))


def missing_blobs(records: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """J5. Referenced refs per vault, flagged present on the vault's remote and in its local cache."""
    refs = live_refs(records).select(*REF).distinct()
    return flag(flag(refs, _refs(remote), REF, "on_remote"), _refs(local), REF, "in_cache")


def verify_blobs(records: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """J5. Per vault: referenced, missing, re-uploadable and unhealable blobs."""
    gone = ~F.col("on_remote")
    return missing_blobs(records, remote, local).groupBy("vault_id").agg(
        F.count(F.lit(1)).alias("referenced"), F.count_if(gone).alias("missing"),
        F.count_if(gone & F.col("in_cache")).alias("reuploaded"),
        F.count_if(gone & ~F.col("in_cache")).alias("unhealable"))


def heal_blobs(records: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """J6. Rows of a vault's local cache to upload again."""
    missing = missing_blobs(records, remote, local).where(~F.col("on_remote")).select(
        "vault_id", F.col("ref").alias("blob_id")).distinct()
    return local.join(missing, BLOB, "left_semi")


def cdc_chunks(files: DataFrame, low: int = CHUNK_MIN, avg: int = CHUNK_AVG,
               high: int = CHUNK_MAX, keep_bytes: bool = True) -> DataFrame:
    """D1 / U4. ``(file_id, content)`` to content-defined chunks, in parallel over files.

    ``keep_bytes=False`` leaves ``bytes`` null when only hashes and sizes are needed.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        for pdf in batches:
            for file_id, content in zip(pdf["file_id"], pdf["content"]):
                at = 0
                for n, end in enumerate(cut_points(content, low, avg, high)):
                    part = content[at:end]
                    rows.append((file_id, n, at, end - at, hashlib.sha256(part).hexdigest(),
                                 part if keep_bytes else None))
                    at = end
                held += len(content)
                if held > FLUSH_BYTES:
                    yield pd.DataFrame(rows, columns=CHUNK_COLUMNS)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=CHUNK_COLUMNS)

    rows = files.select(F.col("file_id").cast("string").alias("file_id"),
                        F.col("content").cast("binary").alias("content"))
    return spread(rows, "file_id").mapInPandas(split, CHUNK_SCHEMA)


def build_manifest(chunks: DataFrame, key: str = "file_id") -> DataFrame:
    """D2. Ordered (hash, size) list per file as JSON, its total size and its hash.

    A manifest is one cell by nature: a file has at most size / min-chunk entries.
    """
    entry = F.struct("ord", "hash", "size")
    listed = chunks.groupBy(key).agg(
        F.sort_array(F.collect_list(entry)).alias("_e"), F.sum("size").alias("total_size"))
    body = F.to_json(F.struct(
        F.transform("_e", lambda e: F.struct(e["hash"].alias("hash"), e["size"].alias("size"),
                                             e["ord"].alias("order"))).alias("chunks"),
        F.col("total_size").alias("totalSize")))
    return listed.select(key, F.size("_e").alias("n_chunks"), "total_size",
                         body.alias("body")).withColumn("manifest", F.sha2("body", 256))


def manifest_diff(old: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """D3. Per file: chunk hashes added, removed and unchanged, as rows."""
    a = old.select(key, "hash").distinct().withColumn("_old", F.lit(True))
    b = new.select(key, "hash").distinct().withColumn("_new", F.lit(True))
    change = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
              .otherwise("unchanged"))
    return a.join(b, [key, "hash"], "full_outer").select(key, "hash", change.alias("change"))


def dedup_stats(chunks: DataFrame, key: str = "file_id") -> DataFrame:
    """D4. Logical against stored bytes and chunks shared between files."""
    per_pair = chunks.groupBy("hash", key).agg(F.count(F.lit(1)).alias("n"),
                                               F.max("size").alias("size"))
    per_hash = per_pair.groupBy("hash").agg(
        F.sum("n").alias("n"), F.max("size").alias("size"), F.count(F.lit(1)).alias("files"))
    return per_hash.agg(
        F.sum("n").alias("chunk_refs"), F.count(F.lit(1)).alias("unique_chunks"),
        F.sum(F.col("n") * F.col("size")).alias("logical_bytes"),
        F.sum("size").alias("stored_bytes"), F.count_if(F.col("files") > 1).alias("shared_chunks"))


def reassemble(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """D5. ``(manifest, ord, hash, size)`` rows to bytes; null when a chunk is missing or
    has another size. Incomplete manifests are settled before any bytes are moved.
    """
    sizes = chunks.select("hash", F.octet_length("bytes").cast("long").alias("_stored"))
    checked = attach(manifests, sizes.groupBy("hash").agg(F.max("_stored").alias("_stored")),
                     ["hash"])
    verdict = checked.groupBy("manifest").agg(
        F.min((F.col("_stored").isNotNull() & (F.col("_stored") == F.col("size")))).alias("ok"),
        F.sum("size").alias("total"))
    whole = manifests.join(verdict.where("ok").select("manifest"), "manifest", "left_semi")
    # A chunk many files share is one of a few broadcast rows of at most one chunk size each.
    unique = chunks.select("hash", "bytes").dropDuplicates(["hash"])
    parts = attach(whole, unique, ["hash"], limit=16).groupBy("manifest").agg(
        F.sort_array(F.collect_list(F.struct("ord", "bytes"))).alias("_p"))
    content = F.aggregate("_p", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["bytes"]))
    return verdict.join(parts.select("manifest", content.alias("content")), "manifest", "left")


def transfer_plan(files: DataFrame, known: DataFrame, low: int = CHUNK_MIN, avg: int = CHUNK_AVG,
                  high: int = CHUNK_MAX) -> DataFrame:
    """D6. Bytes and chunks to send: distinct new chunks only."""
    fresh = cdc_chunks(files, low, avg, high, keep_bytes=False).select("hash", "size").distinct()
    return fresh.join(known.select("hash").distinct(), "hash", "left_anti").agg(
        F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
