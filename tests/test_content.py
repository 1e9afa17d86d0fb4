"""Chunking, manifests, snapshots, paths, settings."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cdc, content, paths, rejections
from tidemark.operators import asof, blobs, settings
from tidemark.sources import snapshot, tables

SIZES = dict(low=256, avg=1024, high=4096)


def noise(n, seed=1):
    return random.Random(seed).randbytes(n)


def test_cut_points_keep_bounds_and_cover():
    data = noise(200_000)
    ends = cdc.cut_points(data, **SIZES)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data)
    assert all(256 < s <= 4096 for s in sizes[:-1]) and sizes[-1] <= 4096
    assert 400 < len(data) / len(ends) < 2600


def test_cut_points_equal_a_byte_by_byte_walk():
    data = noise(20_000, 2)
    bits = 10
    strict, loose = (1 << (bits + 1)) - 1, (1 << (bits - 1)) - 1
    ends, start = [], 0
    while start < len(data):
        if len(data) - start <= 256:
            ends.append(len(data))
            break
        value, end = 0, min(start + 4096, len(data))
        for i in range(start, end):
            value = ((value << 1) + int(cdc.GEAR[data[i]])) & 0xFFFFFFFF
            done = i + 1 - start
            if done > 256 and (value & (strict if done <= 1024 else loose)) == 0:
                end = i + 1
                break
        ends.append(end)
        start = end
    assert cdc.cut_points(data, **SIZES) == ends


def test_small_and_constant_inputs():
    assert cdc.cut_points(b"", **SIZES) == []
    assert cdc.cut_points(b"x" * 256, **SIZES) == [256]
    assert cdc.cut_points(b"x" * 10_000, **SIZES)[-1] == 10_000
    with pytest.raises(ValueError):
        cdc.cut_points(b"x", 2000, 1024, 4096)


def test_an_edit_touches_few_chunks(spark):
    data = noise(100_000, 3)
    edited = data[:50_000] + b"inserted" + data[50_000:]
    df = lambda d: spark.createDataFrame([("f", bytearray(d))], "file_id string, content binary")
    old, new = (blobs.cdc_chunks(df(d), **SIZES) for d in (data, edited))
    diff = {r.change: r["count"] for r in blobs.manifest_diff(old, new).groupBy("change").count().collect()}
    assert diff["added"] <= 5 and diff["unchanged"] > 50
    plan = blobs.transfer_plan(df(edited), old, **SIZES).head()
    assert plan.chunks == diff["added"] and plan.bytes < 15_000
    stats = blobs.dedup_stats(old.unionByName(new.withColumn("file_id", F.lit("g")))).head()
    assert stats.logical_bytes == 200_008 and stats.stored_bytes < 116_000


def test_reassemble_checks_presence_and_size(spark):
    m = spark.createDataFrame([("a", 0, "h1", 2), ("a", 1, "h2", 1), ("b", 0, "h1", 3), ("c", 0, "h9", 1)],
                              "manifest string, ord long, hash string, size long")
    c = spark.createDataFrame([("h1", bytearray(b"xy")), ("h2", bytearray(b"z"))], "hash string, bytes binary")
    got = {r.manifest: r.content and bytes(r.content) for r in blobs.reassemble(m, c).collect()}
    assert got == {"a": b"xyz", "b": None, "c": None}


def test_one_manifest_shape(spark):
    c = spark.createDataFrame([("f", 1, "h2", 5), ("f", 0, "h1", 4)],
                              "file_id string, ord long, hash string, size long")
    r = blobs.build_manifest(c).head()
    assert json.loads(r.body) == {"chunks": [{"hash": "h1", "size": 4, "order": 0},
                                             {"hash": "h2", "size": 5, "order": 1}], "totalSize": 9}


def test_snapshot_hides_dot_segments(spark, tmp_path):
    for rel in ("a.md", "sub/b.txt", ".trash/c.md", "sub/.hidden/d.md"):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(rel.encode())
    got = {r.path: bytes(r.content) for r in snapshot.scan_snapshot(spark, str(tmp_path)).collect()}
    assert got == {"a.md": b"a.md", "sub/b.txt": b"sub/b.txt"}


def test_snapshot_diff_ladder(spark):
    disk = spark.createDataFrame(
        [("new", 1, "h", ["h"]), ("back", 1, "h", ["h"]), ("empty", 0, "e", []), ("same", 3, "h", ["h"]),
         ("multi", 9, "w", ["a", "b"]), ("grown", 9, "w", ["a", "b"]), ("other", 9, "w", ["a", "c"]),
         ("bare", 9, "w", ["a"]), ("edited", 3, "x", ["x"])],
        "path string, size long, hash string, chunk_list array<string>")
    known = spark.createDataFrame(
        [("back", 1, ["h"], True), ("empty", 0, [], False), ("same", 3, ["h"], False),
         ("multi", 9, ["a", "b"], False), ("grown", 8, ["a", "b"], False), ("other", 9, ["a", "b"], False),
         ("bare", 9, [], False), ("edited", 3, ["h"], False), ("lost", 1, ["h"], False), ("old", 1, ["h"], True)],
        "path string, size_bytes long, chunks array<string>, tombstone boolean")
    got = {r.path: r.status for r in asof.snapshot_diff(disk, known).collect()}
    assert got == {"new": "new", "back": "revive", "empty": "unchanged-empty", "same": "unchanged-single",
                   "multi": "unchanged-chunks", "grown": "size-mismatch", "other": "chunk-list-mismatch",
                   "bare": "chunks-empty", "edited": "single-chunk-mismatch", "lost": "missing", "old": "gone"}


def test_paths(spark):
    names = {"a/b.MD": True, "a.b/Makefile": True, ".gitignore": True, "x.": True, "p.png": False,
             "dir.md/p.pdf": False, "é.txt": True}
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert {r.p: r.t for r in df.select("p", paths.classify_text("p").alias("t")).collect()} == names
    ns = uuid.uuid4()
    got = {r.p: r.u for r in df.select("p", paths.file_id(ns, "p").alias("u")).collect()}
    assert got == {n: str(uuid.uuid5(ns, n)) for n in names}
    got = {r.p: r.u for r in df.select("p", paths.file_id_for(F.lit(str(ns)), "p").alias("u")).collect()}
    assert got == {n: str(uuid.uuid5(ns, n)) for n in names}


def test_conflict_copy_names(spark):
    df = spark.createDataFrame([("a.b/n.md",), (".env",), ("plain",)], "p string")
    got = [r.c for r in df.select(paths.conflict_copy_path("p", F.lit(1_704_067_207_179), F.lit("d1")).alias("c")).collect()]
    mark = " (conflict 2024-01-01T000007 from d1)"
    assert got == [f"a.b/n{mark}.md", f".env{mark}", f"plain{mark}"]


def test_setting_classes(spark):
    cases = {
        "app.json": "fieldMap", "graph.json": "fieldMap", ".obsidian/hotkeys.json": "fieldMap",
        "core-plugins.json": "fieldMap", "community-plugins.json": "orSet", "daily-notes.json": "fieldMap",
        "plugins/x/data.json": "wholeFile", "plugins\\x\\data.json": "wholeFile", "themes/t/theme.css": "wholeFile",
        "snippets/a.css": "wholeFile", "workspace.json": None, "workspace-mobile.json": None,
        "plugins/sync-plugin/data.json": None, "plugins/x/main.js": None, "snippets/a.txt": None,
        "a/../app.json": None, "": None, "x.sqlite": None, "x.log": None, "deep/app.json": None}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r.p: r.k for r in df.select("p", paths.classify_setting("p")["kind"].alias("k")).collect()}
    assert got == cases


def test_rejections(spark):
    msgs = {"RpcException: Unauthenticated": ("auth.session_expired", {}, True),
            "app_policy.quota.file_size:size=10,limit=5,limit=6,=x,bad": ("app_policy.quota.file_size", {"size": "10", "limit": "6"}, True),
            "err app_policy.feature.managed_storage_unavailable": ("app_policy.feature.managed_storage_unavailable", {}, True),
            "socket closed": (None, {}, False)}
    df = rejections.parse_rejections(spark.createDataFrame([(m,) for m in msgs], "msg string"))
    assert {r.msg: (r.code, r.params, r.fatal) for r in df.collect()} == msgs
    typed = {r.code: r.typed for r in rejections.typed_rejections(df).collect()}
    assert typed["app_policy.quota.file_size"] == "FileSizeLimitExceeded" and typed[None] is None


def test_text_probe_and_sizes(spark):
    df = spark.createDataFrame([(bytearray(b"a" * 4095 + b"\0"),), (bytearray(b"a" * 4096 + b"\0"),), (bytearray(b""),)], "b binary")
    assert [r.t for r in df.select(content.looks_like_text("b").alias("t")).collect()] == [False, True, True]
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 << 20,)], "n long")
    assert [r.s for r in sizes.select(content.human_size(F.col("n")).alias("s")).collect()] == [
        "0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB"]


def test_json_round_trip(spark):
    docs = {"a": {"x": {"y": [3, 1], "z": None}, "b.c": "é", "e": {}}, "b": 5, "c": {"k": {"k": {"k": 1}}}}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "doc string, json string")
    leaves = settings.flatten_json(df)
    assert {r.path for r in leaves.where("doc = 'a'").collect()} == {'["x","y"]', '["x","z"]', '["b.c"]', '["e"]'}
    back = {r.doc: r.json for r in settings.unflatten(leaves).collect()}
    assert back == {k: content.canonical(json.dumps(v)) for k, v in docs.items()}


def test_t13_deletion_is_not_null(spark):
    state = spark.createDataFrame([("d", '["a"]', "null", True), ("d", '["b"]', "1", False), ("d", '["c"]', "2", True)],
                                  "doc string, path string, val string, present boolean")
    snap = spark.createDataFrame([("d", '["a"]', "null"), ("d", '["b"]', "null")], "doc string, path string, val string")
    got = {(r.path, r.val, r.present) for r in settings.field_map_diff(state, snap).collect()}
    assert got == {('["b"]', "null", True), ('["c"]', None, False)}


def test_orset_is_add_wins(spark):
    adds = spark.createDataFrame([("s", "x", 1), ("s", "x", 2), ("s", "y", 3)], "sid string, elem string, dot long")
    gone = spark.createDataFrame([("s", "x", 1), ("s", "y", 3)], "sid string, elem string, dot long")
    assert [r.elem for r in settings.orset_merge(adds, gone).collect()] == ["x"]
    assert settings.orset_render(adds, gone).head().members == '["x"]'


def test_readers_fill_defaults(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"vault_id":"v","fileId":"f","hlcPacked":"5-1-a","encryptedState":"s"}\n')
    r = tables.read_writes(spark, str(tmp_path / "w.json")).head()
    assert (r.ns, r.blob_ref, r.tombstone, r.chunks, r.context, r.ms, r.cnt, r.node) == (
        "", "", False, [], {}, 5, 1, "a")
    (tmp_path / "h.json").write_text('{"vault_id":"v","deviceId":"d","headSeq":3}\n')
    heads, rows = tables.read_heads(spark, str(tmp_path / "h.json"))
    assert heads.head().has_frontier is False and rows.count() == 0
    (tmp_path / "r.json").write_text(
        '{"vault_id":"v","file_id":"f","payload":"{\\"v\\":1,\\"fileId\\":\\"f\\"}"}\n'
        '{"vault_id":"v","file_id":"g","payload":"{torn"}\n{"vault_id":"v","file_id":"h","payload":"{\\"v\\":9}"}\n')
    ok, bad = tables.read_registers(spark, str(tmp_path / "r.json"))
    assert [x.file_id for x in ok.collect()] == ["f"]
    assert {x.file_id: x.reason for x in bad.collect()} == {"g": "malformed", "h": "version"}
