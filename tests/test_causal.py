import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hlc import hlc, hlc_pack, hlc_parse, parse_context
from tidemark.operators import causal, gates
from tests.helpers import CTX, WRITE, frames, keys_of, lattice, random_log, server


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_register_join_is_the_lattice_join(spark, seed):
    log = random_log(seed)
    w, c = frames(spark, log)
    assert keys_of(causal.register_join(w, c)) == lattice(log)


def test_register_join_idempotent_and_order_free(spark):
    log = random_log(7)
    w, c = frames(spark, log)
    once = keys_of(causal.register_join(w, c))
    shuffled = w.orderBy(F.xxhash64("ms", "node"))
    assert keys_of(causal.register_join(w.unionByName(shuffled), c.unionByName(c))) == once


def test_register_join_in_parts_equals_at_once(spark):
    log = random_log(11)
    w, c = frames(spark, log)
    half = F.col("arrival") < 30
    parts = [causal.register_join(w.where(p), c.where(p)) for p in (half, ~half)]
    again = causal.register_join(parts[0].unionByName(parts[1]), c)
    assert keys_of(again) == keys_of(causal.register_join(w, c))


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("width", [4, 4096])
def test_t1_arrival_join_matches_a_server_simulation(spark, pieces, seed, width):
    pieces(width)
    log = random_log(seed)
    random.Random(seed).shuffle(log)
    w, c = frames(spark, log)
    kept = keys_of(causal.register_join_arrival(w, c))
    assert kept == server(log)
    assert kept >= lattice(log)


def test_t2_packed_clocks_sort_like_structs(spark):
    df = spark.createDataFrame([("99-0-A",), ("100-0-A",), ("100-10-A",), ("100-9-A",)], "p string")
    h = df.select(hlc_parse("p").alias("h"))
    by_struct = [r.h for r in h.orderBy("h").collect()]
    by_text = [r.h for r in h.withColumn("t", hlc_pack("h")).orderBy("t").collect()]
    assert by_struct == by_text
    assert [x.ms for x in by_struct] == [99, 100, 100, 100]


def test_parse_rejects_other_text(spark):
    assert spark.createDataFrame([("nope",)], "p string").select(hlc_parse("p").alias("h")).head().h is None


def test_empty_context_is_empty(spark):
    df = spark.createDataFrame([("",), (None,), ("d0=1-2;d1=3-4",)], "p string")
    got = [r.m for r in df.select(parse_context("p").alias("m")).collect()]
    assert [len(m) for m in got] == [0, 0, 2]


def test_t9_retries_use_sequence_numbers_up(spark, pieces):
    pieces(2)
    rows = [("v", "", b, i, "f", 10 * b + i, 0, "d") for b in range(3) for i in range(4)]
    rows[5] = ("v", "", 1, 1, "f", 0, 0, "d")
    df = spark.createDataFrame(rows, "vault_id string, ns string, batch_id long, item_idx long, "
                                     "file_id string, ms long, cnt long, node string")
    numbered = causal.assign_seq(df)
    assert sorted(r.server_seq for r in numbered.collect()) == list(range(1, 13))
    kept = {r.server_seq for r in causal.dedupe_writes(numbered).collect()}
    assert kept == set(range(1, 13)) - {6}
    told = {r.server_seq: r.result_seq for r in causal.put_results(numbered).collect()}
    assert told[6] == 1


def test_sixteen_batches_of_four(spark, pieces):
    pieces(3)
    rows = [("v", "", b, i) for b in range(16) for i in range(4)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "vault_id string, ns string, batch_id long, item_idx long")
    got = {(r.batch_id, r.item_idx): r.server_seq for r in causal.assign_seq(df).collect()}
    assert [got[k] for k in sorted(got)] == list(range(1, 65))


def test_t10_one_bad_item_rejects_the_batch(spark):
    rows = [("v", "", 1, 100, None), ("v", "", 1, 6 << 20, None), ("v", "", 2, 5 << 20, None),
            ("v", "config", 3, 4 << 20, None), ("v", "config", 4, 3 << 20, None)]
    df = spark.createDataFrame(rows, "vault_id string, ns string, batch_id long, payload_bytes long, "
                                     "expected_epoch long")
    ok, bad = gates.size_gate(df)
    assert sorted(r.batch_id for r in ok.collect()) == [2, 4]
    assert sorted(r.batch_id for r in bad.collect()) == [1, 1, 3]


def test_t10_wrong_epoch_rejects_the_batch(spark):
    rows = [("v", 1, None), ("v", 1, 7), ("v", 2, 3), ("u", 3, 0)]
    df = spark.createDataFrame(rows, "vault_id string, batch_id long, expected_epoch long")
    ep = spark.createDataFrame([("v", 3)], "vault_id string, epoch long")
    ok, bad = gates.epoch_gate(df, ep)
    assert sorted(r.batch_id for r in ok.collect()) == [2, 3]
    assert sorted(r.batch_id for r in bad.collect()) == [1, 1]


def test_t15_late_retry_stays_a_no_op(spark):
    rows = [("v", "f", 1, 0, "a", 1), ("v", "f", 2, 0, "b", 2), ("v", "f", 1, 0, "a", 3)]
    w = spark.createDataFrame(rows, WRITE + ", server_seq long")
    ctx = spark.createDataFrame([("v", "f", "a", (1, 0), 2)], CTX + ", server_seq long")
    kept = causal.register_join_arrival(causal.dedupe_writes(w), ctx, "server_seq")
    assert keys_of(kept) == {("f", 2, 0, "b")}


def test_t14_push_moves_no_base(spark):
    base = spark.createDataFrame([("v", "a", "r1"), ("v", "b", "r1"), ("v", "c", "r1")],
                                 "vault_id string, file_id string, blob_ref string")
    out = spark.createDataFrame(
        [("v", "a", "push", False, "r2"), ("v", "b", "pull", True, "r2"), ("v", "c", "seal", True, ""),
         ("v", "d", "pull", False, "r9")],
        "vault_id string, file_id string, source string, conflicted boolean, blob_ref string")
    got = {r.file_id: r.blob_ref for r in causal.advance_base(base, out).collect()}
    assert got == {"a": "r1", "b": "r1", "d": "r9"}


def test_t7_stats_count_tombstone_values(spark):
    rows = [("v", "f", True, 5, "", [], 1), ("v", "f", True, 5, "", [], 2),
            ("v", "g", False, 7, "m", ["c"], 3), ("v", "g", False, 8, "n", ["c"], 4)]
    df = spark.createDataFrame(rows, "vault_id string, file_id string, tombstone boolean, size_bytes long, "
                                     "blob_ref string, chunks array<string>, server_seq long")
    ep = spark.createDataFrame([("v", 2)], "vault_id string, epoch long")
    r = causal.vault_stats(df, ep).head()
    assert (r.files, r.tombstones, r.conflicting, r.bytes, r.blobs, r.cursor, r.epoch) == (
        2, 2, 2, 15, 3, 4, 2)


@pytest.mark.parametrize("rows", [16, None])
def test_stamps_follow_the_increment_rule(spark, pieces, rows):
    if rows:
        pieces(rows)
    rnd = random.Random(3)
    walls = [("d", i, 1000 + i * 3 - rnd.randrange(12)) for i in range(200)]
    df = spark.createDataFrame(walls, "device string, seq long, wall long")
    got = [(r.ms, r.cnt) for r in causal.stamp_hlc(
        df, "device", "wall", ["seq"]).orderBy("seq").collect()]
    state, want = None, []
    for _, _, wall in walls:
        state = state or (wall, 0)
        state = (wall, 0) if wall > state[0] else (state[0], state[1] + 1)
        want.append(state)
    assert got == want
    assert all(a < b for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("rows", [16, None])
def test_observed_clock_follows_the_receive_rule(spark, pieces, rows):
    if rows:
        pieces(rows)
    rnd = random.Random(4)
    rows = [("d", i, 1000 + i - rnd.randrange(6), 1000 + i - rnd.randrange(4), rnd.randrange(5))
            for i in range(200)]
    df = spark.createDataFrame(rows, "device string, seq long, wall long, r_ms long, r_cnt long")
    got = [(r.clock_ms, r.clock_cnt) for r in causal.observe_hlc(
        df, "device", "wall", "r_ms", "r_cnt", ["seq"]).orderBy("seq").collect()]
    ms, cnt, want = -1, 0, []
    for _, _, wall, r_ms, r_cnt in rows:
        top = max(ms, wall, r_ms)
        if top == ms and top == r_ms:
            cnt = max(cnt, r_cnt) + 1
        elif top == ms:
            cnt += 1
        elif top == r_ms:
            cnt = r_cnt + 1
        else:
            cnt = 0
        ms = top
        want.append((ms, cnt))
    assert got == want


def test_namespaces_are_isolated(spark):
    df = spark.createDataFrame([("v", "", 1), ("v", "config", 2), ("u", "", 3)],
                               "vault_id string, ns string, x long")
    assert [r.x for r in gates.with_keyspace(df, "v").collect()] == [1]
    assert sorted(r.x for r in gates.history_enabled(df).collect()) == [1, 3]


def test_skew_guard_boundary_and_off(spark):
    df = spark.createDataFrame([(1_300_000,), (1_300_001,)], "ms long")
    ok, bad = gates.skew_guard(df, 1_000_000)
    assert ([r.ms for r in ok.collect()], [r.ms for r in bad.collect()]) == ([1_300_000], [1_300_001])
    assert gates.skew_guard(df, 0, None)[0].count() == 2


def test_history_bounds_are_exclusive(spark):
    rows = [(f"e{i}", "v", "f", i, 0, "A") for i in range(95, 106)]
    df = spark.createDataFrame(rows, "event_id string, vault_id string, file_id string, ms long, cnt long, node string")
    at = lambda ms: F.struct(F.lit(ms).cast("long").alias("ms"), F.lit(0).cast("long").alias("cnt"),
                             F.lit("A").alias("node"))
    got = [r.ms for r in gates.history_query(df, "f", after=at(99), before=at(103)).collect()]
    assert got == [102, 101, 100]
    assert hlc() is not None


def test_seals_of_one_device_have_stamps_of_their_own(spark):
    """Files sealed by one device get rising stamps above all that its vault has seen."""
    rows = [(v, f, 10 * i, i, f"n{j}") for v in ("v", "u") for i in range(3) for f in ("a", "b", "c") for j in range(2)]
    log = spark.createDataFrame(rows, "vault_id string, file_id string, ms long, cnt long, node string")
    ctx = spark.createDataFrame([("v", "zz", "n9", (500, 7))],
                                "vault_id string, file_id string, node string, h struct<ms:long,cnt:long>")
    winners = log.where("ms = 20 and node = 'n1' and file_id <> 'c'")
    got = {(r.vault_id, r.file_id): (r.ms, r.cnt, r.node) for r in causal.seal(log, ctx, winners, "me")[0].collect()}
    assert {got["v", f] for f in "ab"} == {(500, 8, "me"), (500, 9, "me")}
    assert {got["u", f] for f in "ab"} == {(20, 3, "me"), (20, 4, "me")}
    late = causal.seal(log, ctx, winners, "me", 100)[0]
    assert {(r.ms, r.cnt) for r in late.where("vault_id = 'u'").collect()} == {(100, 0), (100, 1)}
    assert {(r.ms, r.cnt) for r in late.where("vault_id = 'v'").collect()} == {(500, 8), (500, 9)}
