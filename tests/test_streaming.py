"""Streams against their batch twins, in several micro-batches."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import events as ev
from tidemark.streaming import registers as reg
from tests.helpers import frames, keys_of, lattice, random_log

T0 = datetime(2024, 1, 1)
ECHO = "device string, ts timestamp, seq long, kind string, path string, old_path string, n int, event_id long"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def files_stream(spark, df, folder, parts, key):
    """Write ``df`` as ``parts`` files, one per range of ``key``; one file is one batch."""
    rows = df.orderBy(key).collect()
    step = -(-len(rows) // parts)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i:i + step], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def collect_stream(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name), q


def test_debounce_needs_a_disk_event(spark, tmp_path):
    rows = [("d", "a", 0, "typing"), ("d", "a", 2, "modified"), ("d", "a", 4, "typing"), ("d", "a", 20, "typing"),
            ("d", "b", 1, "modified"), ("d", "b", 10, "modified"), ("d", "z", 500, "typing")]
    df = spark.createDataFrame([(d, p, at(s), k, i) for i, (d, p, s, k) in enumerate(rows)],
                               "device string, path string, ts timestamp, kind string, event_id long")
    want = {("a", 3), ("b", 1)}
    batch = ev.debounce_batch(df)
    assert {(r.path, r.events) for r in batch.collect()} == want and batch.count() == 3
    out, _ = collect_stream(spark, ev.debounce(files_stream(spark, df, tmp_path / "s", 3, "ts")), "debounced")
    assert {(r.path, r.events) for r in out.collect()} == want and out.count() == 3


def simulate_echo(rows, ttl):
    live, out = {}, {}
    for d, ts, seq, kind, path, old, n, event in sorted(rows, key=lambda r: (r[1], r[2])):
        ms = ts.replace(tzinfo=timezone.utc).timestamp() * 1000

        def take(p):
            held = live.get((d, p)) if p else None
            if not held or held[0] <= 0 or ms >= held[1]:
                return False
            held[0] -= 1
            return True

        if kind == "mark":
            held = live.get((d, path))
            before = held[0] if held and ms < held[1] else 0
            live[d, path] = [before + n, ms + ttl]
        else:
            out[d, event] = take(old) or take(path)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_echo_batch_equals_a_simulation(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(250):
        kind = rnd.choice(["mark", "event", "event"])
        old = rnd.choice(["p0", "p1", "p2"]) if kind == "event" and rnd.random() < 0.4 else None
        rows.append((rnd.choice("de"), at(i * 0.3 + rnd.random()), i, kind, f"p{rnd.randrange(3)}", old,
                     rnd.randrange(1, 3) if kind == "mark" else 0, i))
    got = {(r.device, r.event_id): r.suppressed for r in
           ev.suppress_echo_batch(spark.createDataFrame(rows, ECHO), 2000).collect()}
    assert got == simulate_echo(rows, 2000)


def test_echo_stream_equals_a_simulation(spark, tmp_path):
    rnd = random.Random(9)
    rows = []
    for i in range(120):
        kind = rnd.choice(["mark", "event"])
        old = "p1" if kind == "event" and rnd.random() < 0.3 else None
        rows.append((rnd.choice("de"), at(i * 0.5), i, kind, f"p{rnd.randrange(2)}", old, 1 if kind == "mark" else 0, i))
    df = spark.createDataFrame(rows, ECHO)
    body = ev.suppress_echo(str(tmp_path / "out"), 2000)
    reg.run_available(files_stream(spark, df, tmp_path / "s", 3, "ts"), body, str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out" / "rows"))
    assert out.select("batch").distinct().count() == 3
    assert {(r.device, r.event_id): r.suppressed for r in out.collect()} == simulate_echo(rows, 2000)


def test_redelivered_chunks_are_dropped_across_batches(spark, tmp_path):
    rows = [(b, o, 1, at(i)) for i, (b, o) in enumerate([(1, 0), (1, 0), (1, 1), (2, 0), (1, 1), (2, 0)])]
    df = spark.createDataFrame(rows, "blob_id long, off long, len long, ts timestamp")
    out, _ = collect_stream(spark, ev.dedupe_chunks(files_stream(spark, df, tmp_path / "s", 3, "ts")), "deduped")
    assert sorted((r.blob_id, r.off) for r in out.collect()) == [(1, 0), (1, 1), (2, 0)]


def test_blobs_complete_only_when_whole(spark, tmp_path):
    rows = [(1, 0, 4, False, 6), (1, 4, 2, True, 6), (2, 0, 4, False, 6), (3, 4, 2, True, 6), (4, 0, 4, False, 6), (4, 5, 1, True, 6), (5, 0, 3, True, 3)]
    df = spark.createDataFrame([(*r, at(i)) for i, r in enumerate(rows)], "blob_id long, off long, len long, last boolean, total long, ts timestamp")
    want = {1: True, 2: False, 3: False, 4: False, 5: True}
    assert {r.blob_id: r.complete for r in ev.assemble_blobs(df).collect()} == want
    stream = files_stream(spark, df, tmp_path / "s", 3, "ts")
    out, _ = collect_stream(spark, ev.assemble_blobs(stream), "assembled", "complete")
    assert {r.blob_id: r.complete for r in out.collect()} == want


def test_pieces_over_batches_in_any_order(spark, tmp_path):
    chunk = "blob_id string, off long, bytes binary, last boolean, total long, ts timestamp"
    batches = [
        [("a", 4, b"ef", True, 6, at(0)), ("b", 0, b"xy", False, 4, at(0)), ("h", 0, b"12", False, 6, at(0))],
        [("a", 0, b"abcd", False, 6, at(1)), ("a", 0, b"abcd", False, 6, at(1)), ("b", 1, b"zz", False, 4, at(1)),
         ("h", 4, b"56", True, 6, at(1)), ("one", 0, b"!", True, 1, at(1)), (None, 0, b"?", True, 1, at(1))],
        [("a", 4, b"EF", True, 6, at(2)), ("b", 2, b"zw", True, 4, at(2)), ("empty", 0, b"", True, 0, at(2))],
        [("late", 0, b"l", False, 2, at(100)), ("a", 0, b"AAAA", False, 6, at(100))]]
    body = ev.stream_blobs(str(tmp_path / "o"), 60_000)
    for n, rows in enumerate(batches):
        for _ in range(2):
            body(spark.createDataFrame(rows, chunk), n)
    read = lambda name: spark.read.parquet(str(tmp_path / "o" / name)).collect()
    got = {(r.blob_id, r.piece_no): (r.batch, r.off, bytes(r.bytes)) for r in read("pieces")}
    assert got == {("a", 0): (1, 0, b"abcd"), ("a", 1): (1, 4, b"ef"), ("one", 0): (1, 0, b"!"),
                   ("empty", 0): (2, 0, b"")}
    # b holds overlapping chunks and h a hole: neither comes out, both are given up in time.
    assert {(r.blob_id, r.outcome) for r in read("closed")} == {
        ("a", "complete"), ("one", "complete"), ("empty", "complete"), ("b", "expired"), ("h", "expired")}
    left = spark.read.parquet(str(tmp_path / "o" / "state" / "batch=3")).where("outcome is null").collect()
    assert [(r.blob_id, r.off) for r in left] == [("late", 0)]
    assert ev.stale_batches(spark, str(tmp_path / "o"), 3) == [0, 1, 2]


def puts(spark, log):
    rows = [("v", x["file"], x["ms"], x["cnt"], x["node"], i, i % 5 == 0, x["ctx"]) for i, x in enumerate(log)]
    return spark.createDataFrame(rows, "vault_id string, file_id string, ms long, cnt long, node string, server_seq long, "
                                       "tombstone boolean, context map<string,struct<ms:long,cnt:long>>")


def test_registers_over_batches_and_reruns(spark, tmp_path):
    log = random_log(5, 80)
    df = puts(spark, log)
    stream = files_stream(spark, df, tmp_path / "src", 4, "server_seq")
    body = reg.stream_registers(str(tmp_path / "r"))
    reg.run_available(stream, body, str(tmp_path / "cp"))
    assert keys_of(reg.read_stream_registers(spark, str(tmp_path / "r"))) == lattice(log)
    body(df.where("server_seq < 20"), 0)  # a batch that runs again
    assert keys_of(reg.read_stream_registers(spark, str(tmp_path / "r"))) == lattice(log)
    before = reg.read_stream_registers(spark, str(tmp_path / "r"))
    reg.compact_registers(spark, str(tmp_path / "r"), 3)
    assert keys_of(reg.read_stream_registers(spark, str(tmp_path / "r"))) == lattice(log)
    assert keys_of(before) == lattice(log)  # a reader stays on its version
    again = spark.createDataFrame(df.where("server_seq % 3 = 0").collect(), df.schema)
    body(again, 9)  # puts that come again later leave no second value
    assert keys_of(reg.read_stream_registers(spark, str(tmp_path / "r"))) == lattice(log)
    w, c = frames(spark, log)
    assert w.count() == 80 and c.count() > 0


def test_history_over_batches_and_reruns(spark, tmp_path):
    log = random_log(6, 60)
    df = puts(spark, log)
    twice = df.unionByName(df.where("server_seq % 7 = 0").withColumn("server_seq", F.col("server_seq") + 100))
    folder = str(tmp_path / "h")
    body = reg.stream_history(folder)
    reg.run_available(files_stream(spark, twice, tmp_path / "src", 3, "server_seq"), body, str(tmp_path / "cp"))
    rows = spark.read.parquet(folder).orderBy("server_seq").collect()
    assert len(rows) == 60
    body(twice.where("server_seq < 23"), 0)
    rows = spark.read.parquet(folder).orderBy("server_seq").collect()
    assert len(rows) == 60
    seen = set()
    for r in rows:
        assert r.op == ("delete" if r.tombstone else "modify" if r.file_id in seen else "create")
        seen.add(r.file_id)


def test_moves(spark):
    df = spark.createDataFrame([(1, "moved", "n", "o"), (2, "moved", "n", None), (3, "deleted", "n", None)],
                               "event_id long, kind string, path string, old_path string")
    got = {(r.event_id, r.target, r.op) for r in ev.expand_moves(df).collect()}
    assert got == {(1, "o", "deleted"), (1, "n", "changed"), (2, "n", "created"), (3, "n", "deleted")}


def test_rate_limit_window_slides(spark):
    times = [0, 0.1, 0.2, 0.9, 1.05, 5]
    df = spark.createDataFrame([("c", i, at(t)) for i, t in enumerate(times)], "connection string, event_id long, ts timestamp")
    got = {r.event_id: r.calls for r in ev.rate_violations_batch(df, 3).collect()}
    assert got == {3: 4, 4: 4}


def test_rate_limit_counts_in_time_linear_in_the_calls(spark):
    """Ties, windows over two pieces, calls that lie apart and calls without a time; no frame is counted again for each row."""
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), i, rnd.choice([0, 1, 2, 999_999, 1_000_000, rnd.randrange(9_000_000)])) for i in range(300)]
    nulls = [("a", 300, None), ("a", 301, None)]
    df = spark.createDataFrame(rows + nulls, "connection string, event_id long, us long").withColumn("ts", F.timestamp_micros("us"))
    out = ev.rate_violations_batch(df, 3)
    got = {r.event_id: r.calls for r in out.collect()}
    want = {i: sum(d == c and u - 1_000_000 < v <= u for d, _, v in rows) for c, i, u in rows}
    assert got == {i: n for i, n in {**want, 300: 4, 301: 4}.items() if n > 3}
    assert "RangeFrame, -" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    rows = [(1, at(0)), (2, at(3600)), (3, at(7200)), (4, at(60)), (5, at(7300))]
    df = spark.createDataFrame([(i, n, t, 0, 0) for n, (i, t) in enumerate(rows)],
                               "event_id long, n long, ts timestamp, ms long, received_ms long")
    df = df.withColumn("ms", F.unix_millis("ts")).withColumn(
        "received_ms", F.col("ms") - F.when(F.col("event_id") == 5, 300_001).otherwise(0))
    ok, refused = ev.late_guard(files_stream(spark, df, tmp_path / "s", 5, "n"), "received_ms", ["event_id"], "10 minutes")
    out, q = collect_stream(spark, ok, "guarded")
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3]
    assert ev.late_rows(q) == 1
    assert refused.isStreaming


def test_business_counts(spark):
    df = spark.createDataFrame([(at(0), "user.registered", None), (at(5), "payment.completed", 7), (at(90_000), "payment.completed", 8)],
                               "ts timestamp, name string, amount_kopecks long")
    got = [(r.registrations, r.payments, r.amount_kopecks) for r in ev.business_counts(df).orderBy("start_ms").collect()]
    assert got == [(1, 1, 7), (0, 1, 8)]


def test_blob_with_a_hole_beside_an_overlap_is_not_whole(spark):
    rows = [("hole", 0, 2, False, 5), ("hole", 1, 2, False, 5), ("hole", 4, 1, True, 5),
            ("whole", 3, 2, True, 5), ("whole", 0, 3, False, 5)]
    df = spark.createDataFrame(rows, "blob_id string, off long, len long, last boolean, total long")
    got = {r.blob_id: r.complete for r in ev.assemble_blobs(df).collect()}
    assert got == {"hole": False, "whole": True}


def test_keyed_table_versions(spark, tmp_path):
    """Only touched buckets are rewritten; of two writers one begins again; nothing of a batch is applied twice."""
    from tidemark.sources.keyed import KeyedTable

    rows = lambda *x: spark.createDataFrame(x, "k long, v long")
    table = KeyedTable(spark, str(tmp_path / "t"), rows((1, 1)).schema, ["k"], 8)
    held = lambda v=None: {r.k: r.v for r in table.read(v).collect()}
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("v").alias("v"))
    assert held() == {} and table.version()["version"] == 0
    first = table.update(rows(*[(k, 1) for k in range(50)], (None, 1)), add, 0)
    assert held() == {**{k: 1 for k in range(50)}, None: 1}
    second = table.update(rows((7, 10)), add, 1)
    changed = [b for b in first["folders"] if first["folders"][b] != second["folders"][b]]
    assert len(changed) == 1 and held()[7] == 11 and held(first)[7] == 1
    assert table.update(rows((7, 10)), add, 1) == second and held()[7] == 11

    calls = []

    def slow(old, new):
        if not calls:  # another writer is faster
            calls.append(table.rebuild(3)["version"])
        return add(old, new)

    third = table.update(rows((7, 100), (999, 5)), slow, 2)
    assert third["version"] == calls[0] + 1 and third["buckets"] == 3
    assert held() == {**{k: 1 for k in range(50)}, None: 1, 7: 111, 999: 5} and held(second)[7] == 11
    gone = table.update(rows((7, 0), (None, 0)), lambda old, new: old.where("k <> 7"), 3)
    assert 7 not in held() and gone["batch"] == 3
    assert table.update(rows((1, 0)).where("false"), add, 4)["batch"] == 4
    # A version that is still being written does not count.
    (tmp_path / "t" / "versions" / f"{99:020d}.json").write_text("{")
    assert table.version()["batch"] == 4


def test_a_damaged_folder_is_no_empty_table(spark, tmp_path):
    folder = tmp_path / "h"
    folder.mkdir()
    (folder / "part-0.parquet").write_text("no parquet")
    body = reg.stream_history(str(folder))
    with pytest.raises(Exception):
        body(puts(spark, random_log(1, 10)), 1)
