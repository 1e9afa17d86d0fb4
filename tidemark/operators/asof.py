"""As-of lookups and the snapshot comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hlc import hlc
from ..plans.ordered import Running, cut, running
from ..plans.skew import keep_known
from .causal import FILE


def history_base(history: DataFrame, probes: DataFrame) -> DataFrame:
    """J7. For each probe ``(FILE, ms, cnt, node, probe_id)``: ref of the newest event before it.

    History and probes share one running scan per file; an empty ref reads as null.
    """
    at = F.struct("ms", "cnt", "node")
    h = history.select(*FILE, "ms", "cnt", "node", F.lit(1).alias("_kind"),
                       F.struct(hlc().alias("at"), F.col("blob_ref").alias("ref")).alias("_e"),
                       F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"))
    p = probes.select(*FILE, "ms", "cnt", "node", F.lit(0).alias("_kind"),
                      F.lit(None).cast(h.schema["_e"].dataType).alias("_e"), "probe_id")
    both = h.unionByName(p)
    scanned = running(both, FILE, [at, "_kind"], cut(both, "ms"), [Running("_last", "max", F.col("_e"))])
    ref = F.col("_last.ref")
    return scanned.where("_kind = 0").select(
        "probe_id", *FILE, F.when(ref != "", ref).alias("base_ref"))


def merge_base(conflicts: DataFrame, explicit: DataFrame, synced: DataFrame,
               history: DataFrame) -> DataFrame:
    """J8. Merge base per conflicted file: explicit, else last synced, else history before
    the file's oldest value."""
    oldest = conflicts.groupBy(*FILE).agg(F.min(hlc()).alias("_o")).select(
        *FILE, "_o.ms", "_o.cnt", "_o.node", F.concat_ws("/", *FILE).alias("probe_id"))
    found = history_base(keep_known(history, oldest, FILE), oldest)
    return (oldest.select(*FILE)
            .join(explicit.select(*FILE, F.col("blob_ref").alias("_a")), FILE, "left")
            .join(synced.select(*FILE, F.col("blob_ref").alias("_b")), FILE, "left")
            .join(found.select(*FILE, F.col("base_ref").alias("_c")), FILE, "left")
            .select(*FILE, F.coalesce("_a", "_b", "_c").alias("base_ref"),
                    F.when(F.col("_a").isNotNull(), "explicit")
                    .when(F.col("_b").isNotNull(), "synced")
                    .when(F.col("_c").isNotNull(), "history").otherwise("none").alias("source")))


def snapshot_diff(snapshot: DataFrame, registers: DataFrame) -> DataFrame:
    """J10. Compare a disk listing with the registers by path.

    ``snapshot``: path, size, hash, chunk_list. ``registers``: path, size_bytes, chunks,
    tombstone. Hashes only; content stays unread.
    """
    s = snapshot.select("path", "size", "hash", "chunk_list", F.lit(True).alias("_disk"))
    r = registers.select("path", "size_bytes", "chunks", "tombstone", F.lit(True).alias("_known"))
    j = s.join(r, "path", "full_outer")
    disk, known = F.col("_disk").isNotNull(), F.col("_known").isNotNull()
    n = F.size("chunks")
    status = (
        F.when(~disk & F.col("tombstone"), "gone")
        .when(~disk, "missing")
        .when(~known, "new")
        .when(F.col("tombstone"), "revive")
        .when((F.col("size") == 0) & (F.col("size_bytes") == 0), "unchanged-empty")
        .when((n == 1) & (F.col("chunks")[0] == F.col("hash")), "unchanged-single")
        .when((n > 1) & (F.col("size") == F.col("size_bytes"))
              & (F.col("chunks") == F.col("chunk_list")), "unchanged-chunks")
        .when(n == 0, "chunks-empty")
        .when(n == 1, "single-chunk-mismatch")
        .when(F.col("size") != F.col("size_bytes"), "size-mismatch")
        .otherwise("chunk-list-mismatch"))
    return j.select("path", status.alias("status"))
