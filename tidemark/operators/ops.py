"""Operational reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import Running, cut, first_per_key, running


def latest_logs(logs: DataFrame, n: int | None = None) -> DataFrame:
    """W1. Newest ``n`` log rows (top-k, no full sort), or all, newest first."""
    logs = logs.orderBy(F.desc("ts"), F.desc("event_id"))
    return logs if n is None else logs.limit(n)


def pull_report(timings: DataFrame, slow_ms: int = 200) -> DataFrame:
    """W2. Per vault: files, slow files, slowest file, total time."""
    return timings.groupBy("vault_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("took_ms") > slow_ms).alias("slow"),
        F.max(F.struct("took_ms", "file_id")).alias("_s"),
        F.sum("took_ms").alias("total_ms")).select(
        "vault_id", "files", "slow", F.col("_s.file_id").alias("slowest_file"),
        F.col("_s.took_ms").alias("slowest_ms"), "total_ms")


# Status a device shows after each engine event.
STATUS = {
    "connected": "idle", "disconnected": "off", "pushing": "pushing", "pulling": "pulling",
    "file_pushed": "pushing", "file_pulled": "pulling", "blob_upload_progress": "uploading",
    "blob_upload_done": "idle", "blob_download_progress": "downloading",
    "blob_download_done": "idle", "repair_started": "repairing", "repair_progress": "repairing",
    "repair_done": "idle", "error": "error", "session_expired": "auth_expired",
    "subscription_required": "sub_expired", "server_rejected": "sub_expired",
}


def device_status(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """W3. Status per device from its newest status-bearing event; others change nothing."""
    status = F.lit(None).cast("string")
    for kind, shown in STATUS.items():
        status = F.when(F.col("kind") == kind, F.lit(shown)).otherwise(status)
    known = events.withColumn("status", status).where("status is not null")
    return known.groupBy("device").agg(
        F.max_by("status", F.struct(*order)).alias("status"))


# How long a status of these events is shown before the device is idle again.
FALLS_BACK_MS = {"file_pushed": 3_000, "file_pulled": 3_000, "error": 5_000}
# Events that leave a running fall-back as it is, and codes that pause a device.
LEAVES_TIMER = ("started", "connecting", "blob_upload_done", "blob_download_done", "repair_done")
PAUSES = ("auth.", "app_policy.")


def status_at(events: DataFrame, probes: DataFrame, falls_back: dict[str, int] = FALLS_BACK_MS) -> DataFrame:
    """W3 in time. What each device shows at each probe ``(probe_id, device, ms)``.

    ``events``: ``(device, ms, event_id, kind, code, pending)``. Some statuses fall back to idle after a
    while, unless an event that stops the timer came before; the timer also ends a status set meanwhile by an event
    that leaves it running. A ``server_rejected`` counts only with a code that pauses. ``pending`` events
    carry the flag of waiting files, which is shown beside the status. A probe sees the events of its own
    millisecond; a device without any is off. One running scan, whatever a device's share of the rows.
    """
    kind = F.col("kind")
    shown = F.when(kind.isin("started", "connecting"), "connecting")
    for name, status in STATUS.items():
        shown = shown.when(kind == name, status)
    pauses = F.lit(False)
    for start in PAUSES:
        pauses = pauses | F.coalesce(F.col("code").startswith(start), F.lit(False))
    shown = F.when((kind != "server_rejected") | pauses, shown)
    delay = F.lit(None).cast("long")
    for name, ms in falls_back.items():
        delay = F.when(kind == name, F.lit(ms).cast("long")).otherwise(delay)
    place = F.struct(F.col("ms").alias("ms"), F.col("event_id").alias("event_id"))
    status = F.struct(place.alias("at"), shown.alias("status"))
    timer = F.struct(place.alias("at"), (F.col("ms") + delay).alias("ends"))
    flag = F.struct(place.alias("at"), F.col("pending").alias("pending"))
    told = events.select(
        "device", "ms", "event_id", F.lit(0).alias("_probe"),
        F.when(shown.isNotNull(), status).alias("_s"),
        F.when(shown.isNotNull() & ~kind.isin(*LEAVES_TIMER), timer).alias("_t"),
        F.when(kind == "pending", flag).alias("_f"))
    both = told.unionByName(probes.select("probe_id", "device", "ms", F.lit(1).alias("_probe")),
                            allowMissingColumns=True)
    seen = running(both, ["device"], ["ms", "_probe", "event_id"], cut(both, "ms"), [
        Running("_ls", "max", F.col("_s")), Running("_lt", "max", F.col("_t")), Running("_lf", "max", F.col("_f"))])
    ended = (F.col("_lt.ends") <= F.col("ms")) & (F.col("_ls.at.ms") <= F.col("_lt.ends"))
    return seen.where("_probe = 1").select(
        "probe_id", "device", F.when(ended, "idle").otherwise(F.coalesce("_ls.status", F.lit("off"))).alias("status"),
        F.coalesce("_lf.pending", F.lit(False)).alias("pending"))


def pending_files(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """W4. Files whose last mark/clear event is a mark (``kind`` mark or clear)."""
    last = events.where("kind in ('mark', 'clear')").groupBy("device", "path").agg(
        F.max_by("kind", F.struct(*order)).alias("_k"))
    return last.where("_k = 'mark'").select("device", "path")


def pending_flags(events: DataFrame) -> DataFrame:
    """W4. Per device: how many files wait."""
    waiting = pending_files(events).groupBy("device").agg(F.count(F.lit(1)).alias("pending"))
    return events.select("device").distinct().join(waiting, "device", "left").fillna(
        0, ["pending"])


def coalesce_latest(tasks: DataFrame, key: str, order: str) -> DataFrame:
    """W5. Newest pending request per key; its group is the newest one's."""
    return first_per_key(tasks, [key], [F.desc(order)])
