"""Event streams (E1-E4, E8-E11). Each takes a streaming frame; batch twins sit beside."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import skew_guard
from ..plans.ordered import Running, cut, first_per_key, number_rows, running
from ..session import hadoop_path, settle


# E1 ------------------------------------------------------------------------------------
def debounce(events: DataFrame, gap: str = "3 seconds", delay: str = "10 seconds",
             keys: tuple[str, ...] = ("device", "path")) -> DataFrame:
    """E1. One row per quiet period and path, if a disk event was in it; typing extends it."""
    sessions = (events.withWatermark("ts", delay)
                .groupBy(F.session_window("ts", gap).alias("s"), *keys)
                .agg(F.max((F.col("kind") != "typing").cast("int")).alias("_disk"),
                     F.count(F.lit(1)).alias("events")))
    return sessions.where("_disk = 1").select(
        *keys, F.col("s.start").alias("start"), F.col("s.end").alias("fires_at"), "events")


def debounce_batch(events: DataFrame, gap_us: int = 3_000_000,
                   keys: tuple[str, ...] = ("device", "path")) -> DataFrame:
    """E1, batch twin. A path with a third of all events is still scanned in pieces."""
    rows = events.select(*keys, "event_id", "kind", F.unix_micros("ts").alias("us"))
    piece = cut(rows, "us")
    led = running(rows, keys, ["us", "event_id"], piece,
                  [Running("_prev", "max", F.col("us"), before=True)])
    opens = F.col("_prev").isNull() | (F.col("us") - F.col("_prev") > gap_us)
    marked = running(led.withColumn("_open", F.when(opens, F.col("us"))), keys,
                     ["us", "event_id"], piece, [Running("start_us", "max", F.col("_open"))])
    return marked.groupBy(*keys, "start_us").agg(
        F.max((F.col("kind") != "typing").cast("int")).alias("_disk"),
        F.count(F.lit(1)).alias("events"),
        (F.max("us") + gap_us).alias("fires_us")).where("_disk = 1").drop("_disk")


# E2 ------------------------------------------------------------------------------------
def suppress_echo(folder: str, ttl_ms: int = 2_000) -> Callable[[DataFrame, int], None]:
    """E2. ``foreachBatch`` body. Per path our own writes announce (``mark``) how many
    events to swallow; marks lapse ``ttl`` after the last one. A rename may use either name.

    ``ops``: ``(device, ts, seq, kind, path, old_path, n, event_id)``. Between batches only
    the open count and the last mark of each path are kept, as one row that the next batch
    reads as a mark. Every batch has its own folders, so a batch may run again.
    """

    def apply(ops: DataFrame, batch: int) -> None:
        spark = ops.sparkSession
        held = _load_batch(spark, f"{folder}/state", batch - 1)
        tries = _echo_tries(ops)
        if held is not None:
            tries = held.select(*tries.columns).unionByName(tries)
        judged = _settle_echo(tries, ttl_ms)
        _echo_verdicts(judged).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
        order = F.struct("ms", "seq", (~F.col("old")).alias("late"))
        last = judged.groupBy("device", "path").agg(
            F.max(F.struct(order.alias("at"), "held", "last_mark")).alias("l"))
        last.where("l.held > 0").select(
            "device", "path", F.col("l.last_mark").alias("ms"), F.lit(-1).cast("long").alias("seq"),
            F.lit(-1).cast("long").alias("event_id"), F.col("l.held").alias("d"),
            F.lit(False).alias("second"), F.lit(False).alias("old")).write.mode(
            "overwrite").parquet(f"{folder}/state/batch={batch}")

    return apply


def _load_batch(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    """A batch's folder, None if there is none; a damaged folder fails."""
    system, place = hadoop_path(spark, f"{folder}/batch={batch}")
    return spark.read.parquet(f"{folder}/batch={batch}") if system.exists(place) else None


def suppress_echo_batch(ops: DataFrame, ttl_ms: int = 2_000) -> DataFrame:
    """E2 over a stored log: each event with whether it was swallowed."""
    return _echo_verdicts(_settle_echo(_echo_tries(ops), ttl_ms))


def _echo_verdicts(judged: DataFrame) -> DataFrame:
    return judged.where("d < 0").groupBy("device", "event_id").agg(
        F.max("suppressed").alias("suppressed"))


def _echo_tries(ops: DataFrame) -> DataFrame:
    """One row per mark and per name an event could be swallowed under (old names first)."""
    at = ops.withColumn("ms", F.unix_millis("ts"))
    event = F.col("kind") != "mark"
    renamed = event & F.col("old_path").isNotNull()
    own = at.select("device", "path", "ms", F.col("seq").cast("long").alias("seq"), "event_id",
                    F.when(event, -1).otherwise(F.col("n")).cast("long").alias("d"),
                    renamed.alias("second"), F.lit(False).alias("old"))
    return own.unionByName(at.where(renamed).select(
        "device", F.col("old_path").alias("path"), "ms", F.col("seq").cast("long").alias("seq"),
        "event_id", F.lit(-1).cast("long").alias("d"), F.lit(False).alias("second"),
        F.lit(True).alias("old")))


def _settle_echo(tries: DataFrame, ttl_ms: int) -> DataFrame:
    """Judge all tries. A rename counts on its new name only if its old name did not swallow
    it, so the scan repeats until no rename changes its mind; a verdict depends on earlier
    ones only, so it ends."""
    tries = settle(tries)
    eaten = tries.where("false").select("event_id")
    while True:
        open_tries = tries.join(eaten.withColumn("second", F.lit(True)), ["event_id", "second"],
                                "left_anti")
        judged = settle(_judge_echo(open_tries, ttl_ms))
        now = judged.where("old and suppressed").select("event_id")
        if now.exceptAll(eaten).unionByName(eaten.exceptAll(now)).limit(1).count() == 0:
            return judged
        eaten = now


def _judge_echo(tries: DataFrame, ttl_ms: int) -> DataFrame:
    """Per path the open count is marks minus events, held at zero: the running sum less its
    running minimum, within one era of marks that are less than the ttl apart."""
    keys, piece = ["device", "path"], cut(tries, "ms")
    order = ["ms", "seq", F.desc("old")]
    is_mark = F.col("d") > 0
    led = running(tries, keys, order, piece,
                  [Running("_m", "max", F.when(is_mark, F.col("ms")), before=True)])
    live = F.col("_m").isNotNull() & (F.col("ms") - F.col("_m") < ttl_ms)
    led = led.withColumn("last_mark", F.when(is_mark, F.col("ms")).otherwise(F.col("_m")))
    opens = F.when(is_mark & ~live, F.struct("ms", "seq"))
    eras = settle(running(led.withColumn("_live", live).withColumn("_o", opens), keys, order,
                          piece, [Running("_era", "max", F.col("_o"))]))
    idle = eras.where(~is_mark & ~F.col("_live")).withColumn("suppressed", F.lit(False)).withColumn(
        "held", F.lit(0).cast("long"))
    busy = eras.where(is_mark | F.col("_live"))
    summed = running(busy, [*keys, "_era"], order, piece, [Running("_s", "sum", F.col("d"))])
    floor = running(summed, [*keys, "_era"], order, piece,
                    [Running("_f", "min", F.col("_s"), before=True)])
    debt = F.least(F.lit(0), F.coalesce("_f", F.lit(0)))
    before = F.col("_s") - F.col("d") - debt
    judged = floor.withColumn("suppressed", (F.col("d") < 0) & (before > 0)).withColumn(
        "held", F.greatest(before + F.col("d"), F.lit(0)))
    cols = [*tries.columns, "suppressed", "held", "last_mark"]
    return judged.select(*cols).unionByName(idle.select(*cols))


# E3, E4 --------------------------------------------------------------------------------
def dedupe_chunks(chunks: DataFrame, delay: str | None = "10 minutes") -> DataFrame:
    """E3. First delivery of each (blob, offset); ``delay=None`` for a batch frame."""
    if delay is None:
        return chunks.dropDuplicates(["blob_id", "off"])
    return chunks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["blob_id", "off"])


def adopt_ids(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E4. (chunks, refused): only the first chunk of a blob names it, later ones of the same
    upload (``upload_id, seq``) take its name; chunks before any name are refused."""
    named = F.when(F.col("blob_id").isNotNull(), F.struct("seq", "blob_id"))
    led = running(chunks, ["upload_id"], ["seq"], cut(chunks, "seq"),
                  [Running("_id", "max", named)])
    led = led.withColumn("blob_id", F.col("_id.blob_id")).drop("_id")
    return led.where("blob_id is not null"), led.where("blob_id is null")


def assemble_blobs(chunks: DataFrame, first_off: int = 0) -> DataFrame:
    """E4. Per blob: bytes received, and whether it is whole.

    ``chunks``: ``(blob_id, off, len, last, total)`` with byte offsets, already deduped.
    Whole means: starts at ``first_off``, its last chunk arrived and ends at the sum of all
    lengths, which equals the announced total, and every other offset is the end of a chunk
    (compared by the XOR of their hashes, so a hole beside an overlap shows). Runs on streams too (update mode).
    """
    got = chunks.groupBy("blob_id").agg(
        F.sum("len").alias("received"), F.count(F.lit(1)).alias("chunks"),
        F.min("off").alias("_lo"), F.max(F.when(F.col("last"), F.col("off") + F.col("len"))).alias(
            "_end"), F.max("total").alias("total"),
        F.bit_xor(F.xxhash64(F.col("off").cast("long")).bitwiseXOR(
            F.xxhash64((F.col("off") + F.col("len")).cast("long")))).alias("_seams"))
    seams = F.xxhash64(F.lit(first_off).cast("long")).bitwiseXOR(F.xxhash64(F.col("_end").cast("long")))
    whole = ((F.col("_lo") == first_off) & (F.col("_end") == F.col("received") + first_off)
             & (F.col("received") == F.col("total")) & (F.col("_seams") == seams))
    return got.select("blob_id", "chunks", "received", F.coalesce(whole, F.lit(False)).alias(
        "complete"))


def stream_blobs(folder: str, ttl_ms: int = 600_000) -> Callable[[DataFrame, int], None]:
    """E4. ``foreachBatch`` body: the bytes of a blob come out as ordered pieces once it is whole.

    ``chunks``: ``(blob_id, off, bytes, last, total, ts)``. Bytes are written once, to the batch's
    ``staged`` folder; between batches only the intervals of open blobs are kept, with the batch that
    holds their bytes. Of chunks with the same offset the first delivery counts. A blob that no chunk came
    for within ``ttl_ms`` of the newest event is given up; closed blobs are remembered as long,
    so that late repeats do not open them again. No blob is one cell or one task: pieces stay chunks, numbered
    from 0 in ``pieces`` ``(blob_id, piece_no, off, bytes)``; ``closed`` says per blob ``(outcome, chunks,
    received)``. Rows without an id, offset or bytes are left out. Every batch has its own folders, so it may run again.
    """

    def apply(chunks: DataFrame, batch: int) -> None:
        spark = chunks.sparkSession
        here = chunks.where("blob_id is not null and off is not null and bytes is not null").select(
            "blob_id", F.col("off").cast("long").alias("off"), "bytes", "last", "total",
            F.unix_millis("ts").alias("ms"))
        place = f"{folder}/staged/batch={batch}"
        first_per_key(here, ["blob_id", "off"], ["ms", "bytes"]).write.mode("overwrite").parquet(place)
        fresh = spark.read.parquet(place).select(
            "blob_id", "off", F.octet_length("bytes").cast("long").alias("len"), "last", "total", "ms",
            F.lit(batch).cast("long").alias("batch"), F.lit(None).cast("string").alias("outcome"))
        held = _load_batch(spark, f"{folder}/state", batch - 1)
        known = fresh if held is None else held.select(*fresh.columns).unionByName(fresh)
        rows = settle(known)
        shut = rows.where("outcome is not null")
        newest = rows.agg(F.max("ms")).first()[0]
        live = first_per_key(rows.where("outcome is null").join(
            shut.select("blob_id"), "blob_id", "left_anti"), ["blob_id", "off"], ["batch"])
        live = settle(live)
        judged = assemble_blobs(live).join(live.groupBy("blob_id").agg(F.max("ms").alias("ms")), "blob_id")
        late = F.col("ms") < F.lit(newest) - ttl_ms
        judged = settle(judged.withColumn("outcome", F.when(F.col("complete"), "complete").when(late, "expired")))
        closing = judged.where("outcome is not null")
        closing.select("blob_id", "outcome", "chunks", "received").write.mode("overwrite").parquet(
            f"{folder}/closed/batch={batch}")

        whole = live.join(closing.where("complete").select("blob_id"), "blob_id", "left_semi")
        numbered = number_rows(whole.select("blob_id", "off", "batch"), ["blob_id"], ["off"], cut(whole, "off"), "_n")
        batches = [r.batch for r in whole.select("batch").distinct().collect()]  # open batches, not chunks
        staged = spark.read.option("basePath", f"{folder}/staged").schema(
            "blob_id " + here.schema["blob_id"].dataType.simpleString() + ", off long, bytes binary, batch long").parquet(
            *[f"{folder}/staged/batch={b}" for b in sorted({*batches, batch})])
        numbered.join(staged, ["blob_id", "off", "batch"]).select(
            "blob_id", (F.col("_n") - 1).alias("piece_no"), "off", "bytes").write.mode("overwrite").parquet(
            f"{folder}/pieces/batch={batch}")

        marks = closing.select("blob_id", "ms", "outcome").unionByName(
            shut.where(F.col("ms") >= F.lit(newest) - ttl_ms).select("blob_id", "ms", "outcome"))
        live.join(closing.select("blob_id"), "blob_id", "left_anti").unionByName(
            marks, allowMissingColumns=True).write.mode("overwrite").parquet(f"{folder}/state/batch={batch}")

    return apply


def stale_batches(spark: SparkSession, folder: str, batch: int) -> list[int]:
    """E4. Staged batches no open blob needs after ``batch``: their folders may go."""
    oldest = spark.read.parquet(f"{folder}/state/batch={batch}").agg(F.min("batch")).first()[0]
    return list(range(batch + 1 if oldest is None else oldest))


# E8 ------------------------------------------------------------------------------------
def expand_moves(events: DataFrame) -> DataFrame:
    """E8. A move is a delete of the old and a change of the new name; a rename without an
    old name is a creation."""
    change = lambda path, op: F.struct(F.col(path).alias("target"), F.lit(op).alias("op"))
    moved = F.col("kind") == "moved"
    single = F.struct(F.col("path").alias("target"), F.when(moved, "created").otherwise(
        F.col("kind")).alias("op"))
    both = F.array(change("old_path", "deleted"), change("path", "changed"))
    rows = F.when(moved & F.col("old_path").isNotNull(), both).otherwise(F.array(single))
    rest = [c for c in events.columns if c not in ("path", "old_path", "kind")]
    return events.select(*rest, F.explode(rows).alias("_r")).select(*rest, "_r.target", "_r.op")


# E9 ------------------------------------------------------------------------------------
def rate_violations(calls: DataFrame, limit: int = 200, window: str = "1 second",
                    slide: str = "250 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """E9. Sliding windows in which a connection made more than ``limit`` calls."""
    return (calls.withWatermark("ts", delay)
            .groupBy(F.window("ts", window, slide).alias("w"), "connection")
            .agg(F.count(F.lit(1)).alias("calls")).where(F.col("calls") > limit)
            .select("connection", F.col("w.start").alias("start"), "calls"))


def rate_violations_batch(calls: DataFrame, limit: int = 200, window_us: int = 1_000_000) -> DataFrame:
    """E9, batch twin, exact: calls that are over the limit in the window ending at them.

    A window reaches back one window length, so rows are cut into pieces of that length and
    each piece also gets the one before it; no task sees a whole connection. A call counts from its time
    until it leaves the window, so the count is a running sum: what the piece before brought, and one more or less at
    each of these times. Calls without a time stay in one piece, twice, as they do not leave.
    """
    from pyspark.sql import Window

    us = F.unix_micros("ts")
    piece = F.floor(us / window_us).cast("long")
    rows = calls.select("connection", "event_id", F.explode(F.array(
        F.struct(piece.alias("p"), F.lit(True).alias("own"), us.alias("at")),
        F.struct((piece + 1).alias("p"), F.lit(False).alias("own"), (us + window_us).alias("at")))).alias("_x"))
    rows = rows.select("connection", "event_id", "_x.p", "_x.own", "_x.at")
    whole = Window.partitionBy("connection", "p")
    so_far = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.sum(F.when(F.col("own"), 1).otherwise(-1)).over(so_far) + F.count_if(~F.col("own")).over(whole)
    held = F.when(F.col("at").isNull(), F.count(F.lit(1)).over(whole)).otherwise(held)
    return rows.withColumn("calls", held).where(
        F.col("own") & (F.col("calls") > limit)).select("connection", "event_id", "calls")


# E10 -----------------------------------------------------------------------------------
def business_counts(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """E10. Business events per tumbling window: one count per kind, payments and amount."""
    n = lambda name, out: F.count_if(F.col("name") == name).alias(out)
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w")).agg(
        n("user.registered", "registrations"), n("user.signed_in", "sign_ins"),
        n("vault.created", "vaults"), n("sync.session_started", "sessions"),
        n("payment.completed", "payments"),
        F.coalesce(F.sum("amount_kopecks"), F.lit(0)).alias("amount_kopecks"))
        .select(F.unix_millis("w.start").alias("start_ms"), "registrations", "sign_ins", "vaults",
                "sessions", "payments", "amount_kopecks"))


# E11 -----------------------------------------------------------------------------------
def late_guard(stream: DataFrame, received_ms: str, key: list[str], delay: str = "10 minutes",
               max_ahead_ms: int | None = 300_000) -> tuple[DataFrame, DataFrame]:
    """E11. (accepted, refused): rows ahead of their receive time are refused; rows behind
    the watermark are dropped by the keyed step, which also counts them (``late_rows``)."""
    ok, refused = skew_guard(stream, received_ms, max_ahead_ms)
    return ok.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key), refused


def late_rows(query: Any) -> int:
    """Rows a query has dropped for being behind its watermark."""
    return sum(int(op["numRowsDroppedByWatermark"])
               for progress in query.recentProgress for op in progress["stateOperators"])


