"""History, watermarks, retention and garbage collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hlc import hlc
from ..functions.paths import file_id_for
from ..plans.ordered import Running, cut, running, text_axis
from ..plans.skew import attach, keep_known
from .blobs import reassemble
from .causal import FILE

DAY = 86_400_000
FRESH_DAYS = 90


def upsert_heads(reports: DataFrame, width: int | None = None) -> DataFrame:
    """H1. Stored head per device: a report below the stored seq is refused, an equal one
    replaces it. The stored seq is the running maximum, so accepted reports are those not
    below it and the last of them wins. ``width`` is that of `cut`.
    """
    led = running(reports, ["vault_id", "device"], ["arrival"], cut(reports, "arrival", width),
                  [Running("_top", "max", F.col("head_seq"))])
    kept = led.where("head_seq >= _top")
    return kept.groupBy("vault_id", "device").agg(
        F.max(F.struct("arrival", "head_seq", "updated_ms")).alias("h")).select(
        "vault_id", "device", "h.head_seq", "h.updated_ms")


def fresh_heads(heads: DataFrame, now_ms: int, days: int = FRESH_DAYS) -> tuple[DataFrame, DataFrame]:
    """H2. (fresh, stale): ``updated >= now - days`` is fresh."""
    fresh = F.col("updated_ms") >= now_ms - days * DAY
    return heads.where(fresh), heads.where(~fresh)


def safe_head(heads: DataFrame, now_ms: int, ttl_days: int = 30) -> DataFrame:
    """H3. Per vault: smallest head over devices with ``now - updated <= ttl`` (null: none)."""
    active = F.lit(now_ms) - F.col("updated_ms") <= ttl_days * DAY
    return heads.groupBy("vault_id").agg(
        F.min(F.when(active, F.col("head_seq"))).alias("safe_seq"),
        F.count_if(active).alias("active_devices"))


def retention_plan(history: DataFrame, heads: DataFrame, now_ms: int, days: int,
                   ttl_days: int = 30) -> DataFrame:
    """H4. Every event with ``action`` keep/delete and ``reason`` young, protected or expired.

    An event goes when ``created < now - days`` and its seq is at or below the safe head, or
    no device of the vault is active.
    """
    if days < 1:
        raise ValueError("days must be at least 1")
    safe = safe_head(heads, now_ms, ttl_days)
    j = attach(history, safe, ["vault_id"])
    young = F.col("created_ms") >= now_ms - days * DAY
    above = F.col("safe_seq").isNotNull() & (F.col("server_seq") > F.col("safe_seq"))
    reason = F.when(young, "young").when(above, "protected").otherwise("expired")
    return j.withColumn("reason", reason).withColumn(
        "action", F.when(F.col("reason") == "expired", "delete").otherwise("keep")).drop("safe_seq")


def retention_summary(plan: DataFrame) -> DataFrame:
    """H5. Preview per vault."""
    gone, kept = F.col("action") == "delete", F.col("action") == "keep"
    at = F.col("created_ms")
    return plan.groupBy("vault_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(gone).alias("deleted"),
        F.count_if(kept).alias("kept"),
        F.count_if(F.col("reason") == "protected").alias("protected_by_head"),
        F.min(F.when(gone, at)).alias("oldest_deleted"),
        F.max(F.when(gone, at)).alias("newest_deleted"),
        F.min(F.when(kept, at)).alias("oldest_kept"), F.max(F.when(kept, at)).alias("newest_kept"),
        F.max(F.coalesce("active_devices", F.lit(0))).alias("active_devices"))


def event_refs(events: DataFrame) -> DataFrame:
    """Manifest and chunk refs of events, as rows."""
    return events.select("vault_id", F.explode(F.concat(F.array("blob_ref"), "chunks")).alias(
        "ref")).where("ref <> ''")


def live_set(records: DataFrame, base: DataFrame) -> DataFrame:
    """Refs pinned by values (all of a conflict's), their chunks and merge bases."""
    held = records.select("vault_id", F.explode(F.concat(F.array("blob_ref"), "chunks")).alias("ref"))
    return held.unionByName(base.select("vault_id", F.col("blob_ref").alias("ref"))).where(
        "ref <> ''").distinct()


def orphan_blobs(plan: DataFrame, records: DataFrame, base: DataFrame) -> DataFrame:
    """H6. Refs of deleted events nothing else pins, each once per vault."""
    gone = event_refs(plan.where("action = 'delete'")).distinct()
    live = live_set(records, base).unionByName(event_refs(plan.where("action = 'keep'"))).distinct()
    return gone.join(live, ["vault_id", "ref"], "left_anti")


def cache_gc(blobs: DataFrame, records: DataFrame, base: DataFrame) -> DataFrame:
    """H7. Cached blobs ``(vault_id, blob_id)`` nothing in their own vault references."""
    live = live_set(records, base).select("vault_id", F.col("ref").alias("blob_id")).distinct()
    return blobs.join(live, ["vault_id", "blob_id"], "left_anti")


def cache_gc_report(blobs: DataFrame, orphans: DataFrame) -> DataFrame:
    """H7. Scanned and deleted counts."""
    flags = blobs.select(F.lit(1).alias("s"), F.lit(0).alias("d")).unionByName(
        orphans.select(F.lit(0).alias("s"), F.lit(1).alias("d")))
    return flags.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("scanned"),
                     F.coalesce(F.sum("d"), F.lit(0)).alias("deleted"))


def apply_retention(plan: DataFrame, orphans: DataFrame,
                    blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H8. (blobs left, events left). Write the blobs first: an event must never outlive
    the knowledge of its blob. An orphan goes from its own vault's blobs only."""
    gone = orphans.select("vault_id", F.col("ref").alias("blob_id")).distinct()
    return blobs.join(gone, ["vault_id", "blob_id"], "left_anti"), plan.where("action = 'keep'")


def delete_events(history: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H9. (events left, events found); ids that do not exist count for nothing."""
    wanted = ids.select("event_id").distinct()
    return (history.join(wanted, "event_id", "left_anti"),
            history.join(wanted, "event_id", "left_semi"))


def stability_frontier(heads: DataFrame, head_ctx: DataFrame, now_ms: int,
                       days: int = FRESH_DAYS) -> DataFrame:
    """H10. Per vault and author: oldest HLC among active devices' frontiers, for authors
    every active device has seen (``now - updated < days``)."""
    active = heads.where(F.lit(now_ms) - F.col("updated_ms") < days * DAY)
    n = active.groupBy("vault_id").agg(F.countDistinct("device").alias("_n"))
    seen = head_ctx.join(active.select("vault_id", "device"), ["vault_id", "device"], "left_semi")
    per = seen.groupBy("vault_id", "node").agg(
        F.countDistinct("device").alias("_d"), F.min("h").alias("h"))
    return per.join(n, "vault_id").where("_d = _n").select(
        "vault_id", "node", "h.ms", "h.cnt")


def file_versions(history: DataFrame, file_ids: DataFrame, newest_first: bool = False) -> DataFrame:
    """H11. All readable versions of the asked files."""
    v = keep_known(history, file_ids, ["file_id"]).where(F.col("ms").isNotNull())
    return v.orderBy("file_id", hlc().desc()) if newest_first else v


def path_versions(history: DataFrame, vaults: DataFrame, path: str) -> DataFrame:
    """H11. Versions of one path in every vault. ``vaults``: ``(vault_id, vault_uuid)``; the
    file key is derived from the path, so nothing but the key is compared."""
    keys = vaults.select("vault_id", file_id_for("vault_uuid", F.lit(path)).alias("file_id"))
    return keep_known(history, keys, FILE).orderBy("vault_id", hlc().desc())


def content_at(versions: DataFrame, manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """H12. Bytes of each version; null once retention dropped a chunk."""
    wanted = versions.select(F.col("blob_ref").alias("manifest")).where(
        "manifest <> ''").distinct()
    content = reassemble(manifests.join(wanted, "manifest", "left_semi"), chunks).select(
        F.col("manifest").alias("blob_ref"), "content")
    return attach(versions, content, ["blob_ref"])


def restore_versions(picks: DataFrame, latest: DataFrame, now_ms: int | Column,
                     device: str) -> DataFrame:
    """H13. Chosen versions (one per file) as new writes above everything seen.

    ``latest`` is the newest HLC ``(vault_id, ms, cnt)`` of the restoring replica. Event ids may be numbers or text.
    """
    from .causal import stamp_hlc

    wall = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    top = latest.groupBy("vault_id").agg(F.max(F.struct("ms", "cnt")).alias("_top"))
    rows = attach(picks.drop("ms", "cnt", "node"), top, ["vault_id"])
    rows = rows.withColumn("_wall", F.greatest(wall, F.col("_top.ms") + 1))
    if picks.schema["event_id"].dataType.typeName() == "string":  # as read_history gives them
        rows, order, axis = rows.withColumn("_at", F.sha2("event_id", 256)), "_at", text_axis("_at")
    else:
        order, axis = "event_id", F.col("event_id")
    stamped = stamp_hlc(rows, "vault_id", "_wall", [order], axis)
    return stamped.withColumn("node", F.lit(device)).drop("_top", "_wall", "_at")
