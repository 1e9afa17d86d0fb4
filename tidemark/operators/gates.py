"""Filters, policy gates and quarantine splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import human_size
from ..functions.hlc import hlc
from ..plans.skew import attach

Split = tuple[DataFrame, DataFrame]

STATE_SCHEMA = ("v int, fileId string, path string, blobRef string, sizeBytes bigint, "
                "tombstone boolean, chunks array<string>, _bad string")


def with_keyspace(df: DataFrame, vault_id: str, ns: str = "") -> DataFrame:
    """A9. Rows of one (vault, namespace); prunes partitions of a table laid out by them."""
    return df.where((F.col("vault_id") == vault_id) & (F.col("ns") == ns))


def history_enabled(df: DataFrame, namespaces: tuple[str, ...] = ("",)) -> DataFrame:
    """A9. Rows of namespaces that keep history."""
    return df.where(F.col("ns").isin(*namespaces))


def version_gate(df: DataFrame, expected: int = 1, version: str = "v") -> Split:
    """A10. (accepted, quarantined) by payload version; a missing version counts as 1."""
    seen = df.withColumn(version, F.coalesce(F.col(version), F.lit(1)))
    return seen.where(F.col(version) == expected), seen.where(F.col(version) != expected)


def apply_wipes(rows: DataFrame, wipes: DataFrame, at: str) -> DataFrame:
    """A11. Rows written after the last wipe of their keyspace, with the keyspace's epoch."""
    last = wipes.groupBy("vault_id", "ns").agg(F.max("wipe_at").alias("_wiped"),
                                               F.count(F.lit(1)).alias("epoch"))
    joined = attach(rows, last, ["vault_id", "ns"])
    alive = joined.where(F.col("_wiped").isNull() | (F.col(at) > F.col("_wiped")))
    return alive.withColumn("epoch", F.coalesce("epoch", F.lit(0))).drop("_wiped")


def decode_records(df: DataFrame, payload: str = "payload", version: int = 1) -> Split:
    """B3. (decoded, skipped): each record decodes alone, a bad one carries its reason."""
    parsed = df.withColumn("_s", F.from_json(payload, STATE_SCHEMA, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    s = F.col("_s")
    reason = (F.when(s.isNull() | s["_bad"].isNotNull(), "malformed")
              .when(F.coalesce(s["v"], F.lit(1)) != version, "version")
              .when(s["fileId"].isNull(), "no-file"))
    tagged = parsed.withColumn("reason", reason)
    ok = tagged.where("reason is null").select(
        *df.columns, s["fileId"].alias("state_file"), F.coalesce(s["path"], F.lit("")).alias("path"),
        F.coalesce(s["blobRef"], F.lit("")).alias("state_ref"),
        F.coalesce(s["sizeBytes"], F.lit(0)).alias("state_size"),
        F.coalesce(s["tombstone"], F.lit(False)).alias("state_tombstone"),
        F.coalesce(s["chunks"], F.array().cast("array<string>")).alias("state_chunks"))
    return ok, tagged.where("reason is not null").select(*df.columns, "reason")


def skew_guard(df: DataFrame, now_ms: int | str, max_ms: int | None = 300_000,
               ms: str = "ms") -> Split:
    """B4. (accepted, rejected): HLCs more than ``max_ms`` ahead are refused.

    ``now_ms`` is a number or the name of a receive-time column; ``max_ms=None`` is off.
    """
    if max_ms is None:
        return df, df.where(F.lit(False))
    now = F.col(now_ms) if isinstance(now_ms, str) else F.lit(now_ms)
    ahead = F.col(ms) > now + max_ms
    return df.where(~ahead), df.where(ahead)


def _split_batches(writes: DataFrame, keys: list[str], bad: Column, code: str) -> Split:
    flags = writes.groupBy(*keys).agg(F.max(bad.cast("int")).alias("_reject"))
    marked = attach(writes, flags, keys)
    return (marked.where("_reject = 0").drop("_reject"),
            marked.where("_reject = 1").drop("_reject").withColumn("code", F.lit(code)))


def epoch_gate(writes: DataFrame, epochs: DataFrame) -> Split:
    """B5. (accepted, rejected) whole batches by expected epoch; null expects nothing."""
    known = attach(writes, epochs.select("vault_id", F.col("epoch").alias("_epoch")), ["vault_id"])
    bad = F.col("expected_epoch").isNotNull() & (
        F.col("expected_epoch") != F.coalesce("_epoch", F.lit(0)))
    ok, rejected = _split_batches(known, ["vault_id", "batch_id"], bad, "epoch_mismatch")
    return ok.drop("_epoch"), rejected.drop("_epoch")


def size_gate(writes: DataFrame, notes_cap: int = 5 << 20, config_cap: int = 3 << 20,
              size: str = "payload_bytes") -> Split:
    """B6. (accepted, rejected): one item over its namespace's cap rejects the batch."""
    cap = F.when(F.col("ns") == "config", config_cap).otherwise(notes_cap)
    return _split_batches(writes, ["vault_id", "ns", "batch_id"], F.col(size) > cap,
                          "app_policy.quota.state_size")


def delta_since(records: DataFrame, cursor: int, ordered: bool = False) -> DataFrame:
    """B7. Records after a cursor; the range filter reaches the Parquet scan."""
    fresh = records.where(F.col("server_seq") > cursor)
    return fresh.orderBy("server_seq") if ordered else fresh


def new_cursor(delta: DataFrame, cursor: int) -> DataFrame:
    """B7. Per vault, the cursor to ask with next time."""
    return delta.groupBy("vault_id").agg(F.greatest(F.max("server_seq"), F.lit(cursor)).alias(
        "cursor"), F.count(F.lit(1)).alias("records"))


def history_query(history: DataFrame, file_id: str | None = None, after: Column | None = None,
                  before: Column | None = None, limit: int | None = None, asc: bool = False) -> DataFrame:
    """B8. Events strictly between two HLCs, newest first; compares structs, not text.

    All of them, unless a page of ``limit`` rows is asked for; the next page starts ``before`` (or
    ``after``) the last HLC of the one shown."""
    at = hlc()
    if file_id is not None:
        history = history.where(F.col("file_id") == file_id)
    if after is not None:
        history = history.where(at > after)
    if before is not None:
        history = history.where(at < before)
    history = history.orderBy(at.asc() if asc else at.desc(), "event_id")
    return history if limit is None else history.limit(limit)


def whole_file_cap(df: DataFrame, cap: int = 1 << 20, size: str = "size",
                   kind: str = "kind") -> DataFrame:
    """B18. Drop whole-file settings above the cap before their content is read."""
    return df.where(~((F.col(kind) == "wholeFile") & (F.col(size) > cap)))


def settings_hygiene(rows: DataFrame, enabled: list[str], cap: int = 1 << 20,
                     size: str = "state_bytes") -> DataFrame:
    """B19. Each stored resource with what a start does to it: keep, purge or reset."""
    known = F.coalesce(F.col("category").isin(*enabled), F.lit(False))
    return rows.withColumn("action", F.when(~known, "purge")
                           .when(F.col(size) > cap, "reset").otherwise("keep"))


def version_rows(history: DataFrame) -> DataFrame:
    """B20. Display text per version: operation mark, time, human size."""
    mark = (F.when(F.col("op") == "create", "[+]").when(F.col("op") == "modify", "[~]")
            .when(F.col("op") == "delete", "[-]").when(F.col("op") == "move", "[>]"))
    at = F.date_format(F.timestamp_millis("created_ms"), "yyyy-MM-dd HH:mm:ss")
    size = F.when(F.col("op") == "delete", "").otherwise(
        F.concat(F.lit("  ("), human_size(F.col("size_bytes")), F.lit(")")))
    return history.withColumn("label", F.concat(mark, F.lit("  "), at, size))


def stat_changed(snapshot: DataFrame, last: DataFrame) -> DataFrame:
    """B21. Files whose (mtime, size) moved or were never seen; content is not touched."""
    seen = last.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    joined = snapshot.join(seen, "path", "left")
    same = F.col("mtime").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s"))
    return joined.where(~same).drop("_m", "_s")
