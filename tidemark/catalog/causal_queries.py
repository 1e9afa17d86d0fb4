"""Sources, gates and causal joins (A*, B*, C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import NOW_MS, VAULT_KEYS, Inputs, with_state_columns
from ..functions import content, hlc, paths, rejections
from ..operators import causal, gates
from ..session import settle
from ..sources import sinks, snapshot, tables
from .registry import query

VAULT_UUID = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def packed_contexts(i: Inputs):
    entry = F.concat("node", F.lit("="), "h.ms", F.lit("-"), "h.cnt")
    return i.c().groupBy("event_id").agg(
        F.array_join(F.sort_array(F.collect_list(entry)), ";").alias("contextPacked"))


def plain_hlc():
    return F.concat_ws("-", F.col("ms").cast("string"), F.col("cnt").cast("string"), "node")


def contexts_of_puts(i: Inputs):
    """Context rows keyed by the HLC of the write they belong to."""
    w = i.w().select("event_id", F.col("ms").alias("w_ms"), F.col("cnt").alias("w_cnt"),
                     F.col("node").alias("w_node"))
    return i.c().join(w, "event_id")


# A: sources and sinks ------------------------------------------------------------------
@query("a1_read_writes", """select event_id, w.vault_id, w.file_id, ms, cnt, node, blob_ref, tombstone,
 server_seq, cast(case when tombstone then 0 else 2 end as bigint) n_chunks, coalesce(n,0) n_ctx
 from w left join (select event_id, count(*) n from c group by 1) using (event_id)""")
def a1(i: Inputs):
    w = with_state_columns(i.w()).join(packed_contexts(i), "event_id", "left")
    gone = F.col("tombstone")
    out = sinks.scratch_folder(i.spark, "writes")
    w.select("vault_id", F.col("file_id").alias("fileId"),
             F.col("event_id").cast("string").alias("encryptedState"),
             F.when(~gone, F.col("blob_ref")).alias("blobRef"), plain_hlc().alias("hlcPacked"),
             "contextPacked", F.when(gone, True).alias("tombstone"),
             F.when(~gone, F.col("chunks")).alias("chunks"), F.col("server_seq").alias("serverSeq")
             ).write.json(out)
    return tables.read_writes(i.spark, out).select(
        F.col("payload").cast("long").alias("event_id"), *VAULT_KEYS, "ms", "cnt", "node",
        "blob_ref", "tombstone", "server_seq", F.size("chunks").cast("long").alias("n_chunks"),
        F.size("context").cast("long").alias("n_ctx"))


@query("a2_read_history", """select event_id, vault_id, file_id, ms, cnt, node, blob_ref,
 case when op='create' then 'modify' else op end op, created_ms, server_seq from history""")
def a2(i: Inputs):
    out = sinks.scratch_folder(i.spark, "history")
    h = i.history()
    wire = F.when(F.col("op") == "create", "imported").otherwise(F.col("op"))
    h.select(F.col("event_id").cast("string").alias("eventId"), "vault_id",
             F.col("file_id").alias("fileId"), F.when(F.col("blob_ref") != "", F.col("blob_ref")).alias(
                 "blobRef"), plain_hlc().alias("hlcPacked"), wire.alias("operation"),
             F.col("created_ms").alias("createdAtMs"), F.col("server_seq").alias("serverSeq")
             ).write.json(out)
    return tables.read_history(i.spark, out).select(
        F.col("event_id").cast("long").alias("event_id"), *VAULT_KEYS, "ms", "cnt", "node",
        "blob_ref", "op", "created_ms", "server_seq")


@query("a3_read_heads", """select h.vault_id, h.device, head_seq, updated_ms, n is not null has_frontier,
 coalesce(n,0) authors, coalesce(newest,0) newest from heads h left join (select vault_id, device,
 count(*) n, max(h.ms) newest from head_ctx group by 1,2) x using (vault_id, device)""")
def a3(i: Inputs):
    from ..operators.retention import upsert_heads

    entry = F.concat("node", F.lit("="), "h.ms", F.lit("-"), "h.cnt")
    packed = i.head_ctx().groupBy("vault_id", "device").agg(
        F.array_join(F.sort_array(F.collect_list(entry)), ";").alias("frontierPacked"))
    out = sinks.scratch_folder(i.spark, "heads")
    upsert_heads(i.head_reports()).join(packed, ["vault_id", "device"], "left").select(
        "vault_id", F.col("device").alias("deviceId"), F.col("head_seq").alias("headSeq"),
        F.col("updated_ms").alias("updatedAtMs"), "frontierPacked").write.json(out)
    heads, rows = tables.read_heads(i.spark, out)
    per = rows.groupBy("vault_id", "device").agg(
        F.count(F.lit(1)).alias("authors"), F.max("h.ms").alias("newest"))
    return heads.join(per, ["vault_id", "device"], "left").fillna(0, ["authors", "newest"])


def _state_rows(i: Inputs):
    """JSON payload per write; every tenth value of k is torn, others carry odd versions."""
    w = with_state_columns(i.w())
    body = F.to_json(F.struct(
        F.when(F.col("k") % 10 == 7, 9).otherwise(1).alias("v"), F.col("file_id").alias("fileId"),
        "path", F.when(~F.col("tombstone"), F.col("blob_ref")).alias("blobRef"),
        F.col("size_bytes").alias("sizeBytes"), F.when(F.col("tombstone"), True).alias("tombstone"),
        "chunks"))
    torn = F.when(F.col("k") % 10 == 3, F.expr("substr(_body, 1, 12)")).otherwise(F.col("_body"))
    return w.withColumn("_body", body).select("event_id", *VAULT_KEYS, torn.alias("payload"))


@query("a4_read_registers", """select vault_id, count(*) filter (k%10 not in (3,7)) readable,
 count(*) filter (k%10 in (3,7)) skipped,
 cast(sum(size_bytes) filter (k%10 not in (3,7)) as bigint) bytes from w group by 1""")
def a4(i: Inputs):
    out = sinks.scratch_folder(i.spark, "registers")
    _state_rows(i).select(*VAULT_KEYS, "payload").write.json(out)
    ok, bad = tables.read_registers(i.spark, out)
    a = ok.groupBy("vault_id").agg(F.count(F.lit(1)).alias("readable"),
                                   F.sum("state_size").alias("bytes"))
    b = bad.groupBy("vault_id").agg(F.count(F.lit(1)).alias("skipped"))
    return a.join(b, "vault_id", "full_outer").fillna(0)


@query("a5_scan_snapshot")
def a5(i: Inputs):
    return snapshot.scan_snapshot(i.spark, i.folder, "*.parquet").select("path", "size")


@query("a6_blob_inventory", "select distinct store, blob_id from blobs")
def a6(i: Inputs):
    return snapshot.blob_inventory(i.blobs())


@query("a7_write_registers", """select event_id, vault_id, file_id, ms, cnt, node from (
 select event_id, vault_id, file_id, ms, cnt, node from w where rn=1
 and file_id not in (select file_id from surv) union all
 select event_id, vault_id, file_id, ms, cnt, node from surv where not tombstone)""")
def a7(i: Inputs):
    cols = ["event_id", *VAULT_KEYS, "ms", "cnt", "node"]
    first = i.w().where("rn = 1").select(*cols)
    regs = i.registers()
    out = sinks.scratch_folder(i.spark, "register-table")
    sinks.write_registers(first, regs.where("not tombstone").select(*cols), regs, out)
    return i.spark.read.parquet(out).select(*cols)


def prop_manifests(i: Inputs):
    """Each write's props as a manifest of two chunks; chunks of some values are gone."""
    e = i.table("events").select("props").distinct().select(
        F.sha2("props", 256).alias("manifest"), "props",
        F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"))
    parts = e.select("manifest", "k", F.posexplode(F.array(
        F.expr("substr(props, 1, 4)"), F.expr("substr(props, 5)"))).alias("ord", "piece")).select(
        "manifest", "k", F.col("ord").cast("long").alias("ord"), F.sha2("piece", 256).alias("hash"),
        F.octet_length("piece").cast("long").alias("size"), F.col("piece").cast("binary").alias("bytes"))
    chunks = parts.where("k % 10 <> 4 or ord = 0").select("hash", "bytes").distinct()
    return parts.select("manifest", "ord", "hash", "size"), chunks


@query("a8_export_vaults", """with one as (select vault_id, file_id, max(tombstone) t, max(k) k,
 count(*) n, max(size_bytes) s from reg group by 1,2), st as (select *, case when n>1 then 'conflict'
 when t then 'tombstone' when k%10=4 then 'unavailable' else 'exported' end st from one)
 select vault_id, count(*) filter (st='exported') exported,
 cast(coalesce(sum(length('{"k": '||k||'}')) filter (st='exported'),0) as bigint) bytes,
 count(*) filter (st='tombstone') skipped_tombstones,
 count(*) filter (st='conflict') skipped_conflicts,
 count(*) filter (st='unavailable') unavailable from st group by 1""")
def a8(i: Inputs):
    manifests, chunks = prop_manifests(i)
    out = sinks.scratch_folder(i.spark, "export")
    rows = settle(sinks.export_rows(i.registers(), manifests, chunks))
    sinks.export_vaults(rows, out)
    written = i.spark.read.parquet(out).select("vault_id", "path").distinct()
    report = sinks.export_report(rows)
    files = written.groupBy("vault_id").agg(F.count(F.lit(1)).alias("_n"))
    return report.join(files, "vault_id", "left").where(
        "exported = coalesce(_n, 0)").drop("_n")


def with_ns(w):
    return w.withColumn("ns", F.when(F.col("k") % 5 == 0, "config").otherwise(""))


@query("a9_with_keyspace", """select 'config' ns, event_id from w where vault_id='v1' and k%5=0
 union all select '' ns, event_id from w where k%5<>0""")
def a9(i: Inputs):
    w = with_ns(i.w())
    return gates.with_keyspace(w, "v1", "config").select("ns", "event_id").unionByName(
        gates.history_enabled(w).select("ns", "event_id"))


@query("a10_version_gate", """select event_id, case when k%7=0 then 'quarantine' else 'ok' end gate,
 cast(case when k%7=0 then 2 else 1 end as bigint) v from w""")
def a10(i: Inputs):
    w = i.w().withColumn("v", F.when(F.col("k") % 7 == 0, 2).when(F.col("k") % 2 == 0, 1))
    ok, bad = gates.version_gate(w)
    row = lambda df, g: df.select("event_id", F.lit(g).alias("gate"), F.col("v").cast("long").alias("v"))
    return row(ok, "ok").unionByName(row(bad, "quarantine"))


@query("a11_apply_wipes", """with n as (select *, case when k%5=0 then 'config' else '' end ns from w),
 x as (select vault_id, ns, max(server_seq) at_seq, count(*) epoch from n where k=7 or k=10 group by 1,2)
 select event_id, coalesce(epoch,0) epoch from n left join x using (vault_id, ns)
 where at_seq is null or server_seq > at_seq""")
def a11(i: Inputs):
    w = with_ns(i.w())
    wipes = w.where("k = 7 or k = 10").select("vault_id", "ns", F.col("server_seq").alias("wipe_at"))
    return gates.apply_wipes(w, wipes, "server_seq").select("event_id", "epoch")


# B: columns and gates ------------------------------------------------------------------
@query("b1_hlc_pack", """select event_id, lpad(cast(ms as varchar),15,'0')||'-'||
 lpad(cast(cnt as varchar),6,'0')||'-'||node packed, ms, cnt, node from w""")
def b1(i: Inputs):
    w = i.w().withColumn("h", hlc.hlc_parse(plain_hlc()))
    return w.select("event_id", hlc.hlc_pack("h").alias("packed"), "h.ms", "h.cnt", "h.node")


@query("b2_explode_context", "select event_id, node, h.ms ms, h.cnt cnt from c")
def b2(i: Inputs):
    df = packed_contexts(i).withColumn("ctx", hlc.parse_context("contextPacked"))
    return hlc.explode_context(df, "ctx", ["event_id"]).select("event_id", "node", "h.ms", "h.cnt")


@query("b3_decode_records", """select event_id, case k%10 when 3 then 'malformed' when 7 then 'version'
 else '' end reason, case when k%10 in (3,7) then '' else blob_ref end ref from w""")
def b3(i: Inputs):
    ok, bad = gates.decode_records(_state_rows(i))
    return ok.select("event_id", F.lit("").alias("reason"), F.col("state_ref").alias("ref")
                     ).unionByName(bad.select("event_id", "reason", F.lit("").alias("ref")))


@query("b4_skew_guard", """select event_id, ms > ms - (event_id%13)*60000 + 300000 refused
 from w""")
def b4(i: Inputs):
    w = i.w().withColumn("seen_ms", F.col("ms") - (F.col("event_id") % 13) * 60000)
    ok, bad = gates.skew_guard(w, "seen_ms")
    return ok.select("event_id", F.lit(False).alias("refused")).unionByName(
        bad.select("event_id", F.lit(True).alias("refused")))


def put_log(i: Inputs):
    """The write log as a stream of batches of 16 puts, some with an expected epoch."""
    w = with_ns(i.w()).drop("server_seq")
    return w.withColumn("batch_id", F.expr("event_id div 16")).withColumn(
        "item_idx", F.col("event_id") % 16).withColumn(
        "expected_epoch", F.when(F.col("batch_id") % 3 == 0, F.expr("batch_id % 2"))).withColumn(
        "payload_bytes", F.col("size_bytes") * 600)


def epochs(i: Inputs):
    return i.w().select("vault_id").distinct().withColumn(
        "epoch", F.when(F.col("vault_id") == "v1", 1).otherwise(0).cast("long"))


PUTS = """puts as (select w.*, case when k%5=0 then 'config' else '' end ns, event_id//16 batch_id,
 event_id%16 item_idx, case when (event_id//16)%3=0 then (event_id//16)%2 end expected_epoch,
 size_bytes*600 payload_bytes, case when vault_id='v1' then 1 else 0 end epoch from w)"""


@query("b5_epoch_gate", f"""with {PUTS} select event_id, vault_id, batch_id, coalesce(bool_or(
 expected_epoch<>epoch) over (partition by vault_id, batch_id), false) rejected from puts""")
def b5(i: Inputs):
    ok, bad = gates.epoch_gate(put_log(i), epochs(i))
    row = lambda df, r: df.select("event_id", "vault_id", "batch_id", F.lit(r).alias("rejected"))
    return row(ok, False).unionByName(row(bad, True))


@query("b6_size_gate", f"""with {PUTS} select event_id, case when bool_or(payload_bytes >
 case when ns='config' then 3145728 else 5242880 end) over (partition by vault_id, ns, batch_id)
 then 'app_policy.quota.state_size' else '' end code from puts""")
def b6(i: Inputs):
    ok, bad = gates.size_gate(put_log(i))
    return ok.select("event_id", F.lit("").alias("code")).unionByName(bad.select("event_id", "code"))


@query("b7_delta_since", """select vault_id, max(server_seq) cursor, count(*) records,
 cast(sum(size_bytes) as bigint) bytes from w where server_seq>500 group by 1""")
def b7(i: Inputs):
    delta = gates.delta_since(i.w(), 500)
    extra = delta.groupBy("vault_id").agg(F.sum("size_bytes").alias("bytes"))
    return gates.new_cursor(delta, 500).join(extra, "vault_id")


@query("b8_history_query", """select event_id, ms, cnt, node from history where
 (ms>1704500000000 or (ms=1704500000000 and cnt||node>'0d1'))
 and (ms<1706000000000 or (ms=1706000000000 and cnt||node<'0d1'))
""")
def b8(i: Inputs):
    at = lambda ms: F.struct(F.lit(ms).cast("long").alias("ms"), F.lit(0).cast("long").alias("cnt"),
                             F.lit("d1").alias("node"))
    return gates.history_query(i.history(), after=at(1704500000000), before=at(1706000000000)
                               ).select("event_id", "ms", "cnt", "node")


TEXT_LIST = ",".join(f"'{e}'" for e in paths.TEXT_EXTENSIONS)
IS_TEXT = f"""(case when regexp_matches(path, '[^/]\\.[^./]+$') then
 lower(regexp_extract(path, '(\\.[^./]+)$', 1)) in ({TEXT_LIST}) else true end)"""


@query("b9_classify_text", f"select path, {IS_TEXT} is_text from snapshot")
def b9(i: Inputs):
    return i.snapshot().select("path", paths.classify_text("path").alias("is_text"))


@query("b10_looks_like_text", """select doc_id, case when doc_id%7=0 then false when doc_id%5=0
 then strlen(text)>=4096 else true end is_text from documents""")
def b10(i: Inputs):
    d = i.table("documents")
    nul, k = F.lit("\0"), F.col("doc_id")
    body = F.concat(F.when(k % 7 == 0, nul).otherwise(""), "text", F.when(k % 5 == 0, nul).otherwise(""))
    return d.select("doc_id", content.looks_like_text(body.cast("binary")).alias("is_text"))


CLASSIFIED = """select event_id, path, case event_id%12 when 0 then 'fieldMap' when 1 then 'fieldMap'
 when 3 then 'orSet' when 4 then 'wholeFile' when 6 then 'wholeFile' when 7 then 'wholeFile'
 when 9 then 'fieldMap' else '' end kind, case event_id%12 when 0 then 'appSettings'
 when 1 then 'appearance' when 3 then 'communityPluginsEnabled' when 4 then 'communityPluginSettings'
 when 6 then 'themesSnippets' when 7 then 'themesSnippets' when 9 then 'corePluginSettings'
 else '' end category from paths"""


def classified(i: Inputs):
    cls = paths.classify_setting("path")
    return i.paths().select("event_id", "path", F.coalesce(cls["kind"], F.lit("")).alias("kind"),
                            F.coalesce(cls["category"], F.lit("")).alias("category"))


@query("b11_classify_setting", CLASSIFIED)
def b11(i: Inputs):
    return classified(i)


@query("b12_selective", f"""select event_id, category from ({CLASSIFIED})
 where category in ('appearance','themesSnippets')""")
def b12(i: Inputs):
    return paths.selective(classified(i), ["appearance", "themesSnippets", "no-such"]).select(
        "event_id", "category")


@query("b13_file_id", """with x as (select path, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8')||encode(path)) d
 from snapshot) select path, substr(d,1,8)||'-'||substr(d,9,4)||'-5'||substr(d,14,3)||'-'||
 case when substr(d,17,1) in ('0','4','8','c') then '8' when substr(d,17,1) in ('1','5','9','d') then '9'
 when substr(d,17,1) in ('2','6','a','e') then 'a' else 'b' end||substr(d,18,3)||'-'||substr(d,21,12) file_id
 from x""")
def b13(i: Inputs):
    return i.snapshot().select("path", paths.file_id(VAULT_UUID, "path").alias("file_id"))


REJECTED = """select event_id, coalesce(case when msg ilike '%unauthenticated%' then 'auth.session_expired'
 when msg ilike '%payment_required%' then 'app_policy.subscription_required'
 when msg ilike '%permission_denied%' then 'auth.permission_denied'
 when msg like 'app_policy%' then 'app_policy.quota.storage' end,'') code, msg from rejections"""


@query("b14_parse_rejections", f"""select event_id, code, code<>'' fatal,
 coalesce(nullif(regexp_extract(msg,'current=([0-9]+)',1),''),'') cur,
 coalesce(nullif(regexp_extract(msg,'limit=([0-9]+)',1),''),'') lim from ({REJECTED})""")
def b14(i: Inputs):
    p = rejections.parse_rejections(i.rejections())
    return p.select("event_id", F.coalesce("code", F.lit("")).alias("code"), "fatal",
                    F.coalesce(F.col("params")["current"], F.lit("")).alias("cur"),
                    F.coalesce(F.col("params")["limit"], F.lit("")).alias("lim"))


@query("b15_content_hash", "select doc_id, sha256(text) hash from documents")
def b15(i: Inputs):
    return i.table("documents").select("doc_id", content.content_hash("text").alias("hash"))


COPY = """regexp_replace({p}, '(\\.[^.]*)$', '')||' (conflict '||strftime(make_timestamp({m}*1000),
 '%Y-%m-%dT%H%M%S')||' from '||{n}||')'||regexp_extract({p}, '(\\.[^.]*)$', 1)"""


@query("b16_conflict_copy_path", f"select event_id, {COPY.format(p='path', m='ms', n='node')} copy from conf")
def b16(i: Inputs):
    from ..operators.merge import conflicts_of

    return conflicts_of(i.registers()).select(
        "event_id", paths.conflict_copy_path("path", "ms", "node").alias("copy"))


def nested(i: Inputs):
    e = i.table("events")
    return e.select(F.col("event_id").alias("doc"), F.concat(
        F.lit('{ "z": '), "event_id", F.lit(', "a": {"c": '), "props", F.lit(', "b": [2, 1]}}')
    ).alias("json"))


@query("b17_canonical_json", """select doc, '{"a":{"b":[2,1],"c":'||replace(props,' ','')||'},"z":'||doc||'}'
 canonical from nested""")
def b17(i: Inputs):
    return content.canonical_json(nested(i), "json").select("doc", "canonical")


def stored_settings(i: Inputs):
    return classified(i).join(i.table("events").select(
        "event_id", F.round(F.col("value") * 60000).cast("long").alias("size")), "event_id")


STORED = f"""(select x.*, cast(round(value*60000) as bigint) size from ({CLASSIFIED}) x
 join events using (event_id))"""


@query("b18_whole_file_cap", f"""select event_id, kind from {STORED}
 where not (kind='wholeFile' and size>1048576)""")
def b18(i: Inputs):
    return gates.whole_file_cap(stored_settings(i)).select("event_id", "kind")


@query("b19_settings_hygiene", f"""select event_id, case when category not in ('appSettings','themesSnippets',
 'appearance') then 'purge' when size>1048576 then 'reset' else 'keep' end "action" from {STORED}""")
def b19(i: Inputs):
    return gates.settings_hygiene(stored_settings(i), ["appSettings", "themesSnippets", "appearance"],
                                  size="size").select("event_id", "action")


@query("b20_version_rows", """select event_id, case op when 'create' then '[+]' when 'modify' then '[~]'
 else '[-]' end||'  '||strftime(make_timestamp(created_ms*1000),'%Y-%m-%d %H:%M:%S')||
 case when op='delete' then '' when size_bytes*999<1024 then '  ('||size_bytes*999||' B)'
 when size_bytes*999<1048576 then '  ('||format('{:.1f}',size_bytes*999/1024.0)||' KB)'
 else '  ('||format('{:.1f}',size_bytes*999/1048576.0)||' MB)' end label
 from history join w using (event_id)""")
def b20(i: Inputs):
    h = i.history().join(i.w().select("event_id", (F.col("size_bytes") * 999).alias("size_bytes")),
                         "event_id")
    return gates.version_rows(h).select("event_id", "label")


@query("b21_stat_changed", """select path from snapshot where mtime%3000=0 or mtime%4000=0 or mtime%7000=0""")
def b21(i: Inputs):
    s = i.snapshot().drop("content")
    last = s.where("mtime % 4000 <> 0").select(
        "path", F.when(F.col("mtime") % 3000 == 0, F.col("mtime") + 1).otherwise(
            F.col("mtime")).alias("mtime"),
        F.when(F.col("mtime") % 7000 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return gates.stat_changed(s, last).select("path")


# C: registers --------------------------------------------------------------------------
KEPT = ["event_id", *VAULT_KEYS, "node", "ms", "cnt"]


@query("c1_register_join", "select event_id, vault_id, file_id, node, ms, cnt from surv")
def c1(i: Inputs):
    return causal.register_join(i.w(), i.c()).select(*KEPT)


def arrival_contexts(i: Inputs, arrived):
    return i.c().join(arrived.select("event_id", "arrival"), "event_id")


@query("c2_register_join_arrival", """select v.event_id, v.vault_id, v.file_id, v.node, v.ms, v.cnt
 from arr v where not exists (select 1 from c join arr x on x.event_id=c.event_id
 where c.file_id=v.file_id and c.node=v.node and x.arrival>v.arrival
 and c.h >= {'ms':v.ms,'cnt':v.cnt})""")
def c2(i: Inputs):
    a = i.arr()
    return causal.register_join_arrival(a, arrival_contexts(i, a)).select(*KEPT)


def retried(i: Inputs):
    """The log with every tombstone and every large write delivered a second time."""
    w = i.w()
    again = w.where("tombstone or size_bytes > 2000").withColumn(
        "server_seq", F.col("server_seq") + 1_000_000)
    return w.unionByName(again)


RETRIED = """retried as (select * from w union all select * replace (server_seq+1000000 as server_seq)
 from w where tombstone or size_bytes>2000)"""


@query("c3_dedupe_writes", f"""with {RETRIED} select event_id, server_seq, min(server_seq) over
 (partition by file_id, ms, cnt, node) result_seq from retried""")
def c3(i: Inputs):
    puts = causal.put_results(retried(i))
    first = causal.dedupe_writes(retried(i)).select("event_id", F.col("server_seq").alias("_s"))
    return puts.join(first, "event_id").where("result_seq = _s").select(
        "event_id", "server_seq", "result_seq")


@query("c4_assign_seq", f"""with {PUTS} select event_id, ns, row_number() over (partition by vault_id, ns
 order by batch_id, item_idx) server_seq from puts""")
def c4(i: Inputs):
    return causal.assign_seq(put_log(i)).select("event_id", "ns", "server_seq")


@query("c5_put_batch", f"""with {PUTS}, e1 as (select *, coalesce(bool_or(expected_epoch<>epoch) over
 (partition by vault_id, batch_id),false) r1 from puts), e2 as (select *, bool_or(payload_bytes >
 case when ns='config' then 3145728 else 5242880 end) over (partition by vault_id, ns, batch_id) r2
 from e1 where not r1), e3 as (select * replace (row_number() over (partition by vault_id, ns
 order by batch_id, item_idx) as server_seq) from e2 where not r2)
 select v.event_id, v.ns, v.server_seq from e3 v where not exists (select 1 from c join e3 x
 on x.event_id=c.event_id where c.file_id=v.file_id and c.node=v.node and x.ns=v.ns
 and x.server_seq>v.server_seq and c.h >= {{'ms':v.ms,'cnt':v.cnt}})""")
def c5(i: Inputs):
    kept, _ = causal.put_batch(put_log(i), contexts_of_puts(i).drop("event_id"), epochs(i))
    return kept.select("event_id", "ns", "server_seq")


@query("c5_batch_cursors", f"""with {PUTS}, n as (select *, row_number() over (partition by vault_id, ns
 order by batch_id, item_idx) s from puts) select vault_id, ns, batch_id, max(s) cursor,
 count(*) items from n group by 1,2,3""")
def c5_cursors(i: Inputs):
    return causal.batch_cursors(causal.assign_seq(put_log(i)))


@query("c6_derive_ops", "select event_id, op from history")
def c6(i: Inputs):
    return causal.derive_ops(i.w()).select("event_id", "op")


@query("c7_current_values", "select event_id, count(*) over (partition by file_id) n_values from surv")
def c7(i: Inputs):
    return causal.current_values(i.registers()).select("event_id", "n_values")


@query("c7_single_values", "select event_id from surv qualify count(*) over (partition by file_id)=1")
def c7_single(i: Inputs):
    return causal.single_values(i.registers()).select("event_id")


@query("c8_conflict_list", """select vault_id, file_id, count(*) n_values,
 count(distinct blob_ref) filter (not tombstone) n_refs, max(path) path, bool_or(tombstone) has_tombstone
 from reg group by 1,2 having count(*)>1""")
def c8(i: Inputs):
    return causal.conflict_list(i.registers())


@query("c8_conflict_refs", "select distinct vault_id, file_id, blob_ref from conf where not tombstone")
def c8_refs(i: Inputs):
    return causal.conflict_refs(i.registers())


@query("c9_vault_stats", """with f as (select vault_id, file_id, count(*) n,
 count(*) filter (tombstone) t, sum(case when tombstone then 0 else size_bytes end) b,
 max(server_seq) s from reg group by 1,2), b as (select vault_id, count(distinct ref) blobs
 from regrefs group by 1) select vault_id, count(*) files, cast(sum(t) as bigint) tombstones,
 count(*) filter (n>1) conflicting, cast(sum(b) as bigint) bytes, max(s) cursor,
 max(blobs) blobs, cast(case when vault_id='v1' then 1 else 0 end as bigint) epoch
 from f join b using (vault_id) group by 1""")
def c9(i: Inputs):
    return causal.vault_stats(i.registers(), epochs(i))


@query("c10_own_context", """select vault_id, node, max(h).ms ms, max(h).cnt cnt from (
 select vault_id, node, {'ms':ms,'cnt':cnt} h from surv union all
 select w.vault_id, c.node, c.h from c join w using (event_id)) group by 1,2""")
def c10(i: Inputs):
    return causal.own_context(i.registers(), i.c()).select("vault_id", "node", "h.ms", "h.cnt")


def walls(i: Inputs):
    """Device events whose wall clock now and then steps back."""
    e = i.events()
    return e.select("event_id", F.concat(F.lit("d"), F.col("user_id") % 3).alias("device"),
                    (F.col("ms") - (F.col("event_id") % 7) * 600000).alias("wall"),
                    (F.col("ms") - (F.col("event_id") % 5) * 900000).alias("r_ms"),
                    (F.col("event_id") % 4).alias("r_cnt"))


WALLS = """walls as (select event_id, 'd'||(user_id%3) device, epoch_us(ts)//1000-(event_id%7)*600000 wall,
 epoch_us(ts)//1000-(event_id%5)*900000 r_ms, event_id%4 r_cnt from events)"""


@query("c11_stamp_hlc", f"""with {WALLS}, m as (select *, max(wall) over (partition by device order by event_id) ms,
 first_value(wall) over (partition by device order by event_id) w0 from walls)
 select event_id, device, ms, row_number() over (partition by device, ms order by event_id)
 - case when ms=w0 then 0 else 1 end cnt from m""")
def c11(i: Inputs):
    return causal.stamp_hlc(walls(i), "device", "wall", ["event_id"]).select(
        "event_id", "device", "ms", "cnt")


@query("c12_observe_hlc", f"""with {WALLS}, m as (select *, max(greatest(wall,r_ms)) over
 (partition by device order by event_id) clock_ms from walls), n as (select *, row_number() over
 (partition by device, clock_ms order by event_id) i from m)
 select event_id, device, clock_ms, i + max(case when r_ms=clock_ms then r_cnt+1-i when i=1 then 0-i end)
 over (partition by device, clock_ms order by event_id) clock_cnt from n""")
def c12(i: Inputs):
    return causal.observe_hlc(walls(i), "device", "wall", "r_ms", "r_cnt", ["event_id"]).select(
        "event_id", "device", "clock_ms", "clock_cnt")


@query("c13_own_latest", """select vault_id, node, max({'ms':ms,'cnt':cnt}).ms ms,
 max({'ms':ms,'cnt':cnt}).cnt cnt from surv group by 1,2""")
def c13(i: Inputs):
    return causal.own_latest(i.registers())


@query("c14_dirty", """with s as (select * from surv qualify count(*) over (partition by file_id)=1)
 select event_id, case when b.blob_ref is null then 'new' when tombstone then 'tombstone' else 'modified' end
 reason from s left join sync_base b using (file_id) where (b.blob_ref is null and not tombstone)
 or (b.blob_ref is not null and (tombstone or b.blob_ref<>s.blob_ref))""")
def c14(i: Inputs):
    return causal.dirty(i.registers(), i.sync_base()).select("event_id", "reason")


@query("c15_join_report", """select w.vault_id, w.file_id, count(*) incoming, max(server_seq) cursor,
 coalesce(max(n),0) "values" from w left join (select file_id, count(*) n from surv group by 1) using (file_id)
 group by 1,2""")
def c15(i: Inputs):
    return causal.join_report(i.w(), i.registers())


@query("c16_seal", """with t as (select vault_id, max({'ms':ms,'cnt':cnt}) h from (select vault_id, ms, cnt from reg
 union all select vault_id, h.ms, h.cnt from c join (select distinct vault_id, file_id from w) using (file_id)) group by 1)
 select vault_id, file_id, h.ms ms, h.cnt + row_number() over (partition by vault_id order by sha256(file_id)) cnt,
 'sealer' node, cast(1 as bigint) n from t join (select distinct vault_id, file_id from conf) using (vault_id)""")
def c16(i: Inputs):
    from ..operators.merge import conflicts_of
    from ..plans.ordered import first_per_key

    regs = i.registers()
    winners = first_per_key(conflicts_of(regs), VAULT_KEYS, [F.desc("ms"), F.desc("cnt"), F.desc("node")])
    sealed, ctx = causal.seal(regs, i.c(), settle(winners), "sealer")
    cols = [*VAULT_KEYS, "ms", "cnt", "node"]
    log = settle(regs.select(*cols).unionByName(sealed.select(*cols)))
    after = causal.register_join(log, i.c().select(*VAULT_KEYS, "node", "h").unionByName(
        ctx.select(*VAULT_KEYS, "node", "h")))
    return causal.current_values(settle(after)).where("node = 'sealer'").select(
        *cols, F.col("n_values").alias("n"))


@query("c17_advance_base", """with o as (select vault_id, file_id, case when k%3=0 then 'push' when k%3=1 then 'pull'
 else 'seal' end source, count(*) over (partition by file_id)>1 conflicted, blob_ref from
 (select * from surv qualify row_number() over (partition by file_id order by ms desc, cnt desc, node desc)=1)),
 o2 as (select o.* replace (o.file_id in (select file_id from conf) as conflicted) from o),
 m as (select * from o2 where source='seal' or (source='pull' and not conflicted))
 select coalesce(m.file_id, b.file_id) file_id, coalesce(m.blob_ref, b.blob_ref) blob_ref
 from sync_base b full join m using (file_id) where coalesce(m.blob_ref, b.blob_ref)<>''""")
def c17(i: Inputs):
    from ..plans.ordered import first_per_key

    newest = first_per_key(causal.current_values(i.registers()), VAULT_KEYS,
                           [F.desc("ms"), F.desc("cnt"), F.desc("node")])
    k = F.col("k") % 3
    outcomes = newest.select(
        *VAULT_KEYS, F.when(k == 0, "push").when(k == 1, "pull").otherwise("seal").alias("source"),
        (F.col("n_values") > 1).alias("conflicted"), "blob_ref")
    return causal.advance_base(i.sync_base(), outcomes).select("file_id", "blob_ref")
