"""Heads, retention, garbage collection, versions, export."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blobs, retention
from tidemark.sources import sinks

NOW = 1_000 * retention.DAY
HEADS = "vault_id string, device string, head_seq long, updated_ms long"
EVENTS = ("event_id long, vault_id string, file_id string, ms long, cnt long, node string, server_seq long, "
          "created_ms long, blob_ref string, chunks array<string>")


def event(i, age_days, seq, ref="", chunks=(), extra_ms=0):
    at = NOW - age_days * retention.DAY + extra_ms
    return (i, "v", "f", at, 0, "d", seq, at, ref, list(chunks))


def test_upsert_refuses_lower_and_keeps_equal(spark):
    rows = [("v", "d", 1, 5, 10), ("v", "d", 2, 3, 20), ("v", "d", 3, 5, 30), ("v", "e", 4, 9, 1), ("v", "e", 5, 2, 2)]
    df = spark.createDataFrame(rows, "vault_id string, device string, arrival long, head_seq long, updated_ms long")
    got = {r.device: (r.head_seq, r.updated_ms) for r in retention.upsert_heads(df, 2).collect()}
    assert got == {"d": (5, 30), "e": (9, 1)}


def test_t4_three_staleness_rules(spark):
    day = retention.DAY
    rows = [("v", "h90", 1, NOW - 90 * day), ("v", "h91", 1, NOW - 90 * day - 1), ("v", "h30", 7, NOW - 30 * day)]
    heads = spark.createDataFrame(rows, HEADS)
    fresh, stale = retention.fresh_heads(heads, NOW)
    assert {r.device for r in fresh.collect()} == {"h90", "h30"} and [r.device for r in stale.collect()] == ["h91"]
    safe = retention.safe_head(heads, NOW).head()
    assert (safe.safe_seq, safe.active_devices) == (7, 1)
    ctx = spark.createDataFrame([("v", "h30", "a", (5, 0))], "vault_id string, device string, node string, h struct<ms:long,cnt:long>")
    assert retention.stability_frontier(heads, ctx, NOW).count() == 1  # exactly 90 days is stale here


def test_t5_both_bounds_of_the_janitor(spark):
    events = spark.createDataFrame([event(1, 10, 5), event(2, 10, 5, extra_ms=-1), event(3, 11, 6), event(4, 1, 1)], EVENTS)
    heads = spark.createDataFrame([("v", "d", 5, NOW)], HEADS)
    got = {r.event_id: r.reason for r in retention.retention_plan(events, heads, NOW, 10).collect()}
    assert got == {1: "young", 2: "expired", 3: "protected", 4: "young"}
    none = heads.where("false")
    alone = {r.event_id: r.reason for r in retention.retention_plan(events, none, NOW, 10).collect()}
    assert alone[3] == "expired"
    with pytest.raises(ValueError):
        retention.retention_plan(events, heads, NOW, 0)


def test_orphans_spare_everything_pinned(spark):
    events = spark.createDataFrame([
        event(1, 20, 1, "m1", ["a", "b"]), event(2, 20, 2, "m2", ["b", "c"]), event(3, 1, 3, "m3", ["c", "d"])], EVENTS)
    heads = spark.createDataFrame([("v", "d", 9, NOW)], HEADS)
    plan = retention.retention_plan(events, heads, NOW, 10)
    values = spark.createDataFrame([("v", "m4", ["a"])], "vault_id string, blob_ref string, chunks array<string>")
    base = spark.createDataFrame([("v", "m2")], "vault_id string, blob_ref string")
    orphans = retention.orphan_blobs(plan, values, base)
    assert {r.ref for r in orphans.collect()} == {"m1", "b"}
    # Another vault holds the same contents: what is an orphan in one is live in the other.
    other = [("u", x) for x in ("m1", "a", "q")]
    store = spark.createDataFrame([("v", x) for x in ("m1", "a", "b", "z")] + other, "vault_id string, blob_id string")
    left, kept = retention.apply_retention(plan, orphans, store)
    assert {tuple(r) for r in left.select("vault_id", "blob_id").collect()} == {("v", "a"), ("v", "z"), *other}
    assert [r.event_id for r in kept.collect()] == [3]
    values = values.unionByName(spark.createDataFrame([("u", "m1", ["z"])], values.schema))
    gone = retention.cache_gc(store, values, base)
    assert {tuple(r) for r in gone.select("vault_id", "blob_id").collect()} == {
        ("v", "m1"), ("v", "b"), ("v", "z"), ("u", "a"), ("u", "q")}
    summary = retention.retention_summary(plan).head()
    assert (summary.total, summary.deleted, summary.kept, summary.active_devices) == (3, 2, 1, 1)


def test_t3_missing_frontier_empties_the_boundary(spark):
    heads = spark.createDataFrame([("v", "d1", 1, NOW), ("v", "d2", 1, NOW)], HEADS)
    schema = "vault_id string, device string, node string, h struct<ms:long,cnt:long>"
    one = spark.createDataFrame([("v", "d1", "a", (5, 0))], schema)
    assert retention.stability_frontier(heads, one, NOW).count() == 0
    two = spark.createDataFrame([("v", "d1", "a", (5, 0)), ("v", "d2", "a", (4, 9)), ("v", "d2", "b", (1, 0))], schema)
    assert [(r.node, r.ms, r.cnt) for r in retention.stability_frontier(heads, two, NOW).collect()] == [("a", 4, 9)]


def test_t8_versions_are_content_not_manifests(spark):
    manifests = spark.createDataFrame([("m", 0, "h1", 2), ("m", 1, "h2", 2), ("n", 0, "h3", 1)],
                                      "manifest string, ord long, hash string, size long")
    chunks = spark.createDataFrame([("h1", bytearray(b"ab")), ("h2", bytearray(b"cd"))], "hash string, bytes binary")
    events = spark.createDataFrame([event(1, 1, 1, "m"), event(2, 1, 2, "n"), event(3, 1, 3, "")], EVENTS)
    got = {r.event_id: r.content and bytes(r.content) for r in retention.content_at(events, manifests, chunks).collect()}
    assert got == {1: b"abcd", 2: None, 3: None}


def test_export_reports_every_kind(spark, tmp_path):
    rows = [("v", "a", "a.md", "m", False), ("v", "b", "b.md", "n", False), ("v", "c", "c.md", "", True),
            ("v", "d", "d.md", "m", False), ("v", "d", "d.md", "n", False)]
    records = spark.createDataFrame(rows, "vault_id string, file_id string, path string, blob_ref string, tombstone boolean")
    manifests = spark.createDataFrame([("m", 0, "h1", 2), ("n", 0, "h3", 1)], "manifest string, ord long, hash string, size long")
    chunks = spark.createDataFrame([("h1", bytearray(b"ab"))], "hash string, bytes binary")
    out = sinks.export_rows(records, manifests, chunks)
    r = sinks.export_report(out).head()
    assert (r.exported, r.bytes, r.skipped_tombstones, r.skipped_conflicts, r.unavailable) == (1, 2, 1, 1, 1)
    sinks.export_vaults(out, str(tmp_path / "x"))
    back = spark.read.parquet(str(tmp_path / "x")).head()
    assert (back.path, bytes(back.content), back.vault_id) == ("a.md", b"ab", "v")


def test_write_registers_replaces_and_drops(spark, tmp_path):
    schema = "vault_id string, file_id string, x long"
    current = spark.createDataFrame([("v", "a", 1), ("v", "a", 2), ("v", "b", 3), ("v", "c", 4)], schema)
    updates = spark.createDataFrame([("v", "a", 9)], schema)
    touched = spark.createDataFrame([("v", "a", 0), ("v", "b", 0)], schema)
    sinks.write_registers(current, updates, touched, str(tmp_path / "t"))
    got = sorted((r.file_id, r.x) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert got == [("a", 9), ("c", 4)]


def test_delete_events_is_idempotent(spark):
    events = spark.createDataFrame([event(1, 1, 1), event(2, 1, 2)], EVENTS)
    ids = spark.createDataFrame([(1,), (1,), (77,)], "event_id long")
    left, found = retention.delete_events(events, ids)
    assert found.count() == 1 and [r.event_id for r in left.collect()] == [2]
    assert retention.delete_events(left, ids)[1].count() == 0


def test_restore_is_newer_than_everything(spark):
    picks = spark.createDataFrame([event(1, 50, 1, "m"), event(2, 40, 2, "n")], EVENTS)
    latest = spark.createDataFrame([("v", NOW + 5, 3)], "vault_id string, ms long, cnt long")
    got = sorted((r.ms, r.cnt, r.node, r.blob_ref) for r in retention.restore_versions(picks, latest, NOW, "me").collect())
    assert all((ms, cnt) > (NOW + 5, 3) for ms, cnt, _, _ in got) and len(set(got)) == 2
    named = picks.withColumn("event_id", F.concat(F.lit("event-"), "event_id"))
    got = retention.restore_versions(named, latest, NOW, "me")
    assert got.columns == named.columns or set(got.columns) == set(named.columns)
    stamps = {(r.ms, r.cnt) for r in got.collect()}
    assert len(stamps) == 2 and min(stamps) > (NOW + 5, 3)


def test_verify_counts(spark):
    records = spark.createDataFrame([("v", "f", "m", ["a", "b"], False), ("v", "g", "", [], True)],
                                    "vault_id string, file_id string, blob_ref string, chunks array<string>, tombstone boolean")
    ids = lambda *x: spark.createDataFrame(x, "vault_id string, blob_id string")
    remote, cache = ids(("v", "m"), ("u", "a"), ("u", "b")), ids(("v", "a"), ("v", "q"), ("u", "b"))
    r = blobs.verify_blobs(records, remote, cache).head()
    assert (r.referenced, r.missing, r.reuploaded, r.unhealable) == (3, 2, 1, 1)
    assert [tuple(x) for x in blobs.heal_blobs(records, remote, cache).collect()] == [("v", "a")]
    asked = ids(("v", "m"), ("v", "m"), ("v", "a"), ("u", "a"), ("u", "m"))
    assert sorted(map(tuple, blobs.blobs_exist(asked, remote).collect())) == [("u", "a"), ("v", "m")]
    wanted = blobs.prefetch_plan(records.unionByName(records.withColumn("vault_id", F.lit("u"))), ids(("u", "m")))
    assert [tuple(x) for x in wanted.collect()] == [("v", "m", 0)]
    known = blobs.known_chunks(records.withColumn("chunks", F.array().cast("array<string>")))
    assert [x.ref for x in known.collect()] == ["m"]
