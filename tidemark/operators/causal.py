"""Causal joins and register algebra (C*).

Rows are ``(vault_id, file_id, ms, cnt, node, ...)``; contexts are exploded rows
``(vault_id, file_id, node, h)`` with ``h = struct(ms, cnt)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hlc import hlc, stamp
from ..plans.ordered import Running, cut, first_per_key, number_rows, running, text_axis
from ..plans.skew import attach
from ..session import settle

FILE = ["vault_id", "file_id"]
HLC = ["ms", "cnt", "node"]


def frontier(ctx: DataFrame) -> DataFrame:
    """Newest HLC per node any write of the file had seen; combined map-side."""
    return ctx.groupBy(*FILE, "node").agg(F.max("h").alias("seen"))


def register_join(writes: DataFrame, ctx: DataFrame) -> DataFrame:
    """C1. Values no other value's context contains.

    A context is a per-node maximum, so "some context of the file contains v" is the same
    as "the file's frontier on v's node has reached v": one aggregate and one equi-join
    instead of a self-join. Inputs may be unions of any number of logs, in any order.
    """
    marked = attach(writes, frontier(ctx), [*FILE, "node"])
    alive = marked.where(F.col("seen").isNull() | (F.col("seen") < stamp())).drop("seen")
    return alive.dropDuplicates([*FILE, *HLC])


def register_join_arrival(writes: DataFrame, ctx: DataFrame, arrival: str = "arrival",
                          keys: list[str] = FILE) -> DataFrame:
    """C2. Server semantics: only a later-arriving context drops a value.

    ``ctx`` carries the arrival of the write it belongs to. Scanning arrivals backwards, a
    running maximum of contexts holds exactly what arrived after each value.
    """
    seen = ctx.select(*keys, "node", F.col(arrival).alias("_at"), F.lit(1).alias("_kind"),
                      F.col("h").alias("_h"), F.lit(None).cast("string").alias("_row"))
    row = F.struct(*writes.columns)
    values = writes.select(*keys, "node", F.col(arrival).alias("_at"), F.lit(0).alias("_kind"),
                           F.lit(None).cast("struct<ms:bigint,cnt:bigint>").alias("_h"),
                           row.alias("_row"))
    seen = seen.withColumn("_row", F.lit(None).cast(values.schema["_row"].dataType))
    both = values.unionByName(seen)
    scanned = running(both, [*keys, "node"], [F.desc("_at"), "_kind"], cut(both, -F.col("_at")),
                      [Running("_after", "max", F.col("_h"))])
    alive = scanned.where("_kind = 0").select("_row.*", "_after")
    return alive.where(F.col("_after").isNull() | (F.col("_after") < stamp())).drop("_after")


def dedupe_writes(writes: DataFrame, order: str = "server_seq",
                  keys: list[str] = FILE) -> DataFrame:
    """C3. First put of each (file, hlc); later puts of the same value are no-ops."""
    return first_per_key(writes, [*keys, *HLC], [order])


def put_results(writes: DataFrame, seq: str = "server_seq", keys: list[str] = FILE) -> DataFrame:
    """Every put with the sequence it is told: a retry hears the first one."""
    first = writes.groupBy(*keys, *HLC).agg(F.min(seq).alias("result_seq"))
    return attach(writes, first, [*keys, *HLC])


def assign_seq(writes: DataFrame, keyspace: tuple[str, ...] = ("vault_id", "ns"),
               batch: str = "batch_id", item: str = "item_idx") -> DataFrame:
    """C4. Sequence per keyspace over batches and items; retries use numbers up too."""
    return number_rows(writes, list(keyspace), [batch, item], cut(writes, batch), "server_seq")


def put_batch(writes: DataFrame, ctx: DataFrame, epochs: DataFrame,
              notes_cap: int = 5 << 20, config_cap: int = 3 << 20) -> tuple[DataFrame, DataFrame]:
    """C5. Full push: gates, sequence, idempotence, arrival join.

    Returns the surviving records and one row per accepted put (``result_seq``).
    ``ctx`` is keyed by the write's ``(vault_id, file_id, w_ms, w_cnt, w_node)``.
    """
    from .gates import epoch_gate, size_gate

    keyspace = [*FILE, "ns"]
    admitted, _ = epoch_gate(writes, epochs)
    admitted, _ = size_gate(settle(admitted), notes_cap, config_cap)
    numbered = settle(assign_seq(settle(admitted)))
    results = put_results(numbered, keys=keyspace)
    kept = dedupe_writes(numbered, keys=keyspace)
    owner = kept.select(*keyspace, F.col("ms").alias("w_ms"), F.col("cnt").alias("w_cnt"),
                        F.col("node").alias("w_node"), "server_seq")
    arriving = ctx.join(owner, [*FILE, "w_ms", "w_cnt", "w_node"])
    return register_join_arrival(kept, arriving, "server_seq", keys=keyspace), results


def batch_cursors(results: DataFrame) -> DataFrame:
    """Cursor each batch is answered with."""
    return results.groupBy("vault_id", "ns", "batch_id").agg(
        F.max("server_seq").alias("cursor"), F.count(F.lit(1)).alias("items"))


def derive_ops(records: DataFrame, order: str = "server_seq") -> DataFrame:
    """C6. delete for a tombstone, create for a file's first record, else modify."""
    first = records.groupBy(*FILE).agg(F.min(order).alias("_first"))
    return attach(records, first, FILE).withColumn(
        "op", F.when(F.col("tombstone"), "delete")
        .when(F.col(order) == F.col("_first"), "create").otherwise("modify")).drop("_first")


def current_values(survivors: DataFrame) -> DataFrame:
    """C7. Every concurrent value with the size of its register."""
    sizes = survivors.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n_values"))
    return attach(survivors, sizes, FILE)


def single_values(survivors: DataFrame) -> DataFrame:
    """C7. Values of registers without a conflict."""
    return current_values(survivors).where("n_values = 1").drop("n_values")


def conflict_list(survivors: DataFrame) -> DataFrame:
    """C8. One row per file with more than one value."""
    live_ref = F.when(~F.col("tombstone"), F.col("blob_ref"))
    per_ref = survivors.withColumn("_ref", live_ref).groupBy(*FILE, "_ref").agg(
        F.count(F.lit(1)).alias("_n"), F.max("path").alias("_path"),
        F.max("tombstone").alias("_tomb"))
    return per_ref.groupBy(*FILE).agg(
        F.sum("_n").alias("n_values"), F.count("_ref").alias("n_refs"),
        F.max("_path").alias("path"), F.max("_tomb").alias("has_tombstone")
    ).where("n_values > 1")


def conflict_refs(survivors: DataFrame) -> DataFrame:
    """C8. Distinct live refs of conflicted files, one row each (no per-file list)."""
    return current_values(survivors).where("n_values > 1 and not tombstone").select(
        *FILE, "blob_ref").distinct()


def vault_stats(records: DataFrame, epochs: DataFrame) -> DataFrame:
    """C9. Per vault: files, tombstone values, conflicts, distinct blobs, bytes, cursor, epoch."""
    per_file = records.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("tombstone").alias("t"),
        F.sum(F.when(~F.col("tombstone"), F.col("size_bytes")).otherwise(0)).alias("b"),
        F.max("server_seq").alias("s"))
    files = per_file.groupBy("vault_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("t").alias("tombstones"),
        F.count_if(F.col("n") > 1).alias("conflicting"), F.sum("b").alias("bytes"),
        F.max("s").alias("cursor"))
    blobs = (live_refs(records).select("vault_id", "ref").distinct()
             .groupBy("vault_id").agg(F.count(F.lit(1)).alias("blobs")))
    return (files.join(blobs, "vault_id", "left").join(epochs, "vault_id", "left")
            .withColumn("blobs", F.coalesce("blobs", F.lit(0)))
            .withColumn("epoch", F.coalesce("epoch", F.lit(0))))


def live_refs(records: DataFrame) -> DataFrame:
    """Manifest and chunk refs of non-tombstone values, as rows."""
    return records.where(~F.col("tombstone")).select(
        *FILE, F.explode(F.concat(F.array("blob_ref"), "chunks")).alias("ref")).where("ref <> ''")


def own_context(values: DataFrame, ctx: DataFrame,
                keys: tuple[str, ...] = ("vault_id",)) -> DataFrame:
    """C10. Per-node maximum of every dot and context a replica has seen."""
    dots = values.select(*keys, "node", stamp().alias("h"))
    return dots.unionByName(ctx.select(*keys, "node", "h")).groupBy(*keys, "node").agg(
        F.max("h").alias("h"))


def stamp_hlc(events: DataFrame, device: str, wall: str, order: list[str],
              axis: Column | None = None) -> DataFrame:
    """C11. Strictly monotone HLCs per device, also when the wall clock steps back.

    ``ms`` is the running maximum of the wall clock. The counter restarts at 0 when the
    wall clock moves on and counts up while it does not; a device's very first stamp is
    taken over an initial ``(wall, 0)`` and so starts at 1. ``axis`` is a whole number that grows
    with ``order``; the first column of it by default.
    """
    piece = cut(events, order[0] if axis is None else axis)
    moved = F.col("_p").isNull() | (F.col(wall) > F.col("_p"))
    led = running(events, [device], order, piece,
                  [Running("ms", "max", F.col(wall)), Running("_p", "max", F.col(wall), before=True),
                   Running("_n", "count")])
    counted = running(led, [device], order, piece, [Running("_o", "max", F.when(moved, F.col("_n")))])
    cnt = F.col("_n") - F.col("_o") + F.when(F.col("_o") == 1, 1).otherwise(0)
    return counted.withColumn("cnt", cnt).select(*events.columns, "ms", "cnt")


def observe_hlc(received: DataFrame, device: str, wall: str, r_ms: str, r_cnt: str,
                order: list[str], axis: Column | None = None) -> DataFrame:
    """C12. Device clock after each received HLC (starting from an empty clock).

    Receiving takes ``ms = max(own, remote, wall)`` and a counter above every counter that
    had that ``ms``. Within a run of equal ``ms`` the counter is ``max(c, remote) + 1`` per
    step, which unrolls to position + running max of (remote + 1 - position). The clock never steps
    back, so that maximum, taken with the clock in front, starts anew with each run.
    """
    piece = cut(received, order[0] if axis is None else axis)
    now = F.greatest(wall, r_ms)
    led = running(received, [device], order, piece,
                  [Running("clock_ms", "max", now), Running("_p", "max", now, before=True),
                   Running("_n", "count")])
    opening = F.when(F.col("_p").isNull() | (now > F.col("_p")), 0)
    bid = F.when(F.col(r_ms) == F.col("clock_ms"), F.col(r_cnt) + 1).otherwise(opening) - F.col("_n")
    bids = F.when(bid.isNotNull(), F.struct(F.col("clock_ms").alias("at"), bid.alias("bid")))
    scanned = running(led, [device], order, piece, [Running("_top", "max", bids)])
    return scanned.withColumn("clock_cnt", F.col("_top.bid") + F.col("_n")).select(
        *received.columns, "clock_ms", "clock_cnt")


def own_latest(records: DataFrame, keys: tuple[str, ...] = ("vault_id",)) -> DataFrame:
    """C13. Latest surviving HLC of each device."""
    return records.groupBy(*keys, "node").agg(F.max(stamp()).alias("h")).select(
        *keys, "node", "h.ms", "h.cnt")


def dirty(registers: DataFrame, base: DataFrame) -> DataFrame:
    """C14. What a push sends: new, modified or tombstone-to-commit; conflicts wait."""
    single = single_values(registers)
    j = single.join(base.select(*FILE, F.col("blob_ref").alias("_base")), FILE, "left")
    reason = (F.when(F.col("_base").isNull() & ~F.col("tombstone"), "new")
              .when(F.col("_base").isNotNull() & F.col("tombstone"), "tombstone")
              .when(F.col("_base") != F.col("blob_ref"), "modified"))
    return j.withColumn("reason", reason).where("reason is not null").drop("_base")


def join_report(incoming: DataFrame, joined: DataFrame) -> DataFrame:
    """C15. Per file: values received and values left; files nothing is left of show 0."""
    received = incoming.groupBy(*FILE).agg(F.count(F.lit(1)).alias("incoming"),
                                           F.max("server_seq").alias("cursor"))
    left = joined.groupBy(*FILE).agg(F.count(F.lit(1)).alias("values"))
    return received.join(left, FILE, "left").withColumn("values", F.coalesce("values", F.lit(0)))


def seal(records: DataFrame, ctx: DataFrame, winners: DataFrame, sealer: str,
         now_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """C16. Re-issue each winner above every value of its file.

    Stamps come from the sealer's clock in each vault: it starts at the newest stamp of the vault, or at a
    later ``now_ms``, and counts up by file, so no two files get the same. Returns the sealing writes and their
    contexts; joined with the log (C1) they leave one value per sealed file.
    """
    every = own_context(records, ctx, tuple(FILE))
    context = every.join(winners.select(*FILE), FILE, "left_semi")
    clock = every.groupBy("vault_id").agg(F.max("h").alias("_top"))
    placed = winners.withColumn("_place", F.sha2("file_id", 256))
    counted = number_rows(placed, ["vault_id"], ["_place"], cut(placed, text_axis("_place")), "_n")
    led = counted.join(clock, "vault_id")
    later = F.lit(now_ms) > F.col("_top.ms") if now_ms is not None else F.lit(False)
    writes = (led.withColumn("ms", F.when(later, F.lit(now_ms)).otherwise(F.col("_top.ms")).cast("long"))
              .withColumn("cnt", F.when(later, F.col("_n") - 1).otherwise(F.col("_top.cnt") + F.col("_n")))
              .withColumn("node", F.lit(sealer)).select(*winners.columns))
    return writes, context


def advance_base(base: DataFrame, outcomes: DataFrame) -> DataFrame:
    """C17. New merge base per file.

    ``outcomes`` holds ``(vault_id, file_id, source, conflicted, blob_ref)`` with source
    pull, seal or push. Only conflict-free pulls and seals move the base, and an empty ref
    (tombstone) clears it.
    """
    moved = outcomes.where("source = 'seal' or (source = 'pull' and not conflicted)").select(
        *FILE, F.col("blob_ref").alias("_new"))
    joined = base.join(moved, FILE, "full_outer")
    return joined.select(*FILE, F.coalesce("_new", "blob_ref").alias("blob_ref")).where(
        "blob_ref <> ''")


def packed_hlc() -> Column:
    from ..functions.hlc import hlc_pack

    return hlc_pack(hlc())
