"""Blob joins, as-of joins, chunking, merging, text, settings, retention (J*, D*, M*, S*, H*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import NOW_MS, VAULT_KEYS, Inputs, with_state_columns
from ..functions.hlc import hlc
from ..functions.paths import is_hidden
from ..operators import asof, blobs, causal, merge, retention, settings, text
from ..plans.ordered import first_per_key
from ..session import settle
from .causal_queries import COPY, IS_TEXT, VAULT_UUID, nested, prop_manifests
from .registry import query

CHUNK = dict(low=256, avg=1024, high=4096)
NOT_HIDDEN = "not (path like '.%' or path like '%/.%')"


def remote(i: Inputs):
    return i.vault_blobs().where("store = 'remote'")


def local(i: Inputs):
    return i.vault_blobs().where("store = 'local'")


# J -------------------------------------------------------------------------------------
@query("j1_blobs_exist", """select distinct vault_id, ref blob_id from refs r where exists (select 1 from vault_blobs b
 where b.vault_id=r.vault_id and b.blob_id=r.ref and store='remote')""")
def j1(i: Inputs):
    return blobs.blobs_exist(i.refs().select("vault_id", F.col("ref").alias("blob_id")), remote(i))


@query("j2_upload_plan", """select distinct ref from refs where ref not in
 (select blob_id from blobs where store='remote')""")
def j2(i: Inputs):
    return blobs.upload_plan(i.refs(), i.blobs().where("store = 'remote'").withColumnRenamed("blob_id", "ref"))


@query("j3_known_chunks", """select distinct vault_id, ref from (select vault_id, 'c'||k ref from reg
 where not tombstone and k%2=0 union all select vault_id, 'c'||((k*7)%100) from reg where not tombstone
 and k%2=0 union all select vault_id, blob_ref from reg where not tombstone and k%2=1)""")
def j3(i: Inputs):
    r = i.registers().withColumn("chunks", F.when(F.col("k") % 2 == 0, F.col("chunks")).otherwise(
        F.array().cast("array<string>")))
    return blobs.known_chunks(r)


@query("j4_prefetch_plan", """with m as (select distinct vault_id, blob_ref ref from w where not tombstone
 and (vault_id, blob_ref) not in (select (vault_id, blob_id) from vault_blobs where store='remote'))
 select vault_id, ref, (row_number() over (partition by vault_id order by ref)-1)//8 batch_no from m""")
def j4(i: Inputs):
    return blobs.prefetch_plan(i.w(), remote(i))


MISSING = """miss as (select *, exists(select 1 from vault_blobs b where b.vault_id=r.vault_id and b.blob_id=r.ref and store='remote') on_remote,
 exists(select 1 from vault_blobs b where b.vault_id=r.vault_id and b.blob_id=r.ref and store='local') in_cache
 from (select distinct vault_id, ref from regrefs) r)"""


@query("j5_verify_blobs", f"""with {MISSING} select vault_id, count(*) referenced,
 count(*) filter (not on_remote) missing, count(*) filter (not on_remote and in_cache) reuploaded,
 count(*) filter (not on_remote and not in_cache) unhealable from miss group by 1""")
def j5(i: Inputs):
    return blobs.verify_blobs(i.registers(), remote(i), local(i))


@query("j6_heal_blobs", f"""with {MISSING} select distinct b.vault_id, b.blob_id, b.store from vault_blobs b
 join miss on b.vault_id=miss.vault_id and b.blob_id=ref where store='local' and not on_remote""")
def j6(i: Inputs):
    return blobs.heal_blobs(i.registers(), remote(i), local(i))


@query("j7_history_base", """select p.event_id probe_id, p.vault_id, p.file_id, coalesce((select case when h.blob_ref<>''
 then h.blob_ref end from history h where h.file_id=p.file_id and
 {'a':h.ms,'b':h.cnt,'c':h.node} < {'a':p.ms-3600000,'b':p.cnt,'c':p.node}
 order by h.ms desc, h.cnt desc, h.node desc limit 1),'') base_ref from w p""")
def j7(i: Inputs):
    probes = i.w().select(*VAULT_KEYS, (F.col("ms") - 3600000).alias("ms"), "cnt", "node",
                          F.col("event_id").alias("probe_id"))
    return asof.history_base(i.history(), probes).fillna("", ["base_ref"])


def explicit_base(i: Inputs):
    return i.registers().groupBy(*VAULT_KEYS).agg(
        F.min("blob_ref").alias("blob_ref")).where(F.substring("file_id", 2, 9).cast("int") % 5 == 0)


@query("j8_merge_base", """with o as (select vault_id, file_id, min({'ms':ms,'cnt':cnt,'node':node}) h from conf group by 1,2),
 x as (select file_id, min(blob_ref) r from surv where cast(substr(file_id,2) as int)%5=0 group by 1),
 y as (select o.*, x.r a, b.blob_ref b, (select case when e.blob_ref<>'' then e.blob_ref end from history e
 where e.file_id=o.file_id and {'ms':e.ms,'cnt':e.cnt,'node':e.node} < o.h
 order by e.ms desc, e.cnt desc, e.node desc limit 1) c from o left join x using (file_id)
 left join sync_base b using (file_id))
 select vault_id, file_id, coalesce(a,b,c,'') base_ref, case when a is not null then 'explicit'
 when b is not null then 'synced' when c is not null then 'history' else 'none' end source from y""")
def j8(i: Inputs):
    conf = merge.conflicts_of(i.registers())
    return asof.merge_base(settle(conf), explicit_base(i), i.sync_base(), i.history()).fillna(
        "", ["base_ref"])


@query("j10_snapshot_diff", f"""with s as (select path, size, hash from snapshot where {NOT_HIDDEN}),
 p as (select *, case when size_bytes%13=0 then 0 when size_bytes%11=0 then 2 else 1 end n from prior)
 select coalesce(s.path,p.path) path, case when s.path is null and tombstone then 'gone'
 when s.path is null then 'missing' when p.path is null then 'new' when tombstone then 'revive'
 when size=0 and size_bytes=0 then 'unchanged-empty' when n=1 and chunk=hash then 'unchanged-single'
 when n=2 and size=size_bytes and chunk=hash then 'unchanged-chunks' when n=0 then 'chunks-empty'
 when n=1 then 'single-chunk-mismatch' when size<>size_bytes then 'size-mismatch'
 else 'chunk-list-mismatch' end status from s full join p on s.path=p.path""")
def j10(i: Inputs):
    disk = i.snapshot().where(~is_hidden("path")).withColumn("chunk_list", F.array("hash", "hash"))
    size = F.col("size_bytes")
    known = i.prior().withColumn("chunks", F.when(size % 13 == 0, F.array().cast("array<string>"))
                                 .when(size % 11 == 0, F.array("chunk", "chunk"))
                                 .otherwise(F.array("chunk")))
    return asof.snapshot_diff(disk, known)


# D -------------------------------------------------------------------------------------
def corpus(i: Inputs):
    return i.table("documents").select(F.col("doc_id").alias("file_id"),
                                       F.col("text").alias("content"))


@query("d1_cdc_chunks", """select cast(doc_id as varchar) file_id, strlen(text) total, sha256(text) hash,
 true in_bounds from documents where text<>''""")
def d1(i: Inputs):
    chunks = blobs.cdc_chunks(corpus(i), **CHUNK)
    last = F.max("ord")
    per = chunks.groupBy("file_id").agg(
        F.sum("size").alias("total"), last.alias("_last"),
        F.max("size").alias("_max"), F.count(F.lit(1)).alias("_n"),
        F.sort_array(F.collect_list(F.struct("ord", "size", "bytes"))).alias("_p"))
    body = F.aggregate("_p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["bytes"]))
    early_small = F.exists("_p", lambda p: (p["ord"] < F.col("_last")) & (p["size"] <= CHUNK["low"]))
    ok = (F.col("_max") <= CHUNK["high"]) & (F.col("_n") == F.col("_last") + 1) & ~early_small
    return per.select("file_id", "total", F.sha2(body, 256).alias("hash"), ok.alias("in_bounds"))


def fixed(i: Inputs):
    return i.fixed_chunks().select(F.col("doc_id").alias("file_id"), "ord", "hash",
                                   F.octet_length("piece").cast("long").alias("size"), "piece")


@query("d2_build_manifest", """select doc_id file_id, count(*) n_chunks, cast(sum(strlen(piece)) as bigint) total_size,
 sha256('{"chunks":['||string_agg('{"hash":"'||hash||'","size":'||strlen(piece)||',"order":'||ord||'}', ','
 order by ord)||'],"totalSize":'||sum(strlen(piece))||'}') manifest from fixed_chunks group by 1""")
def d2(i: Inputs):
    return blobs.build_manifest(fixed(i)).drop("body")


@query("d3_manifest_diff", """with o as (select distinct doc_id//2 file_id, hash from fixed_chunks where doc_id%2=0),
 n as (select distinct doc_id//2 file_id, hash from fixed_chunks where doc_id%2=1)
 select coalesce(o.file_id,n.file_id) file_id, coalesce(o.hash,n.hash) hash, case when o.hash is null
 then 'added' when n.hash is null then 'removed' else 'unchanged' end change
 from o full join n on o.file_id=n.file_id and o.hash=n.hash""")
def d3(i: Inputs):
    pair = fixed(i).withColumn("v", F.col("file_id") % 2).withColumn(
        "file_id", F.expr("file_id div 2"))
    return blobs.manifest_diff(pair.where("v = 0"), pair.where("v = 1"))


@query("d4_dedup_stats", """with h as (select hash, count(*) n, max(strlen(piece)) size, count(distinct doc_id) files
 from fixed_chunks group by 1) select cast(sum(n) as bigint) chunk_refs, count(*) unique_chunks,
 cast(sum(n*size) as bigint) logical_bytes, cast(sum(size) as bigint) stored_bytes,
 count(*) filter (files>1) shared_chunks from h""")
def d4(i: Inputs):
    return blobs.dedup_stats(fixed(i))


@query("d4_dedup_stats_cdc")
def d4_cdc(i: Inputs):
    return blobs.dedup_stats(blobs.cdc_chunks(corpus(i), **CHUNK, keep_bytes=False))


@query("d5_reassemble", """with g as (select doc_id, bool_and(hash not like '0%') ok, cast(sum(strlen(piece)) as bigint) total
 from fixed_chunks group by 1) select doc_id "manifest", ok, total,
 case when ok then sha256(text) else '' end hash from g join documents using (doc_id)""")
def d5(i: Inputs):
    chunks = fixed(i)
    stored = chunks.where("hash not like '0%'").select("hash", F.col("piece").cast("binary").alias("bytes"))
    out = blobs.reassemble(chunks.select(F.col("file_id").alias("manifest"), "ord", "hash", "size"),
                           stored)
    return out.select("manifest", F.coalesce("ok", F.lit(False)).alias("ok"), "total",
                      F.coalesce(F.sha2("content", 256), F.lit("")).alias("hash"))


@query("d6_transfer_plan")
def d6(i: Inputs):
    half = F.expr("cast(length(content) div 2 as int)")
    edited = corpus(i).withColumn("content", F.concat(
        F.substr("content", F.lit(1), half), F.lit(" [edited] "), F.substr("content", half + 1)))
    return blobs.transfer_plan(edited, blobs.cdc_chunks(corpus(i), **CHUNK, keep_bytes=False), **CHUNK)


# M -------------------------------------------------------------------------------------
def conf(i: Inputs):
    return merge.conflicts_of(i.registers())


@query("m1_resolve_same_content", """select vault_id, file_id, max({'ms':ms,'cnt':cnt,'node':node}).ms ms,
 max({'ms':ms,'cnt':cnt,'node':node}).cnt cnt, max({'ms':ms,'cnt':cnt,'node':node}).node node,
 min(blob_ref) blob_ref, 'same-blob' strategy from conf group by 1,2
 having min(blob_ref)=max(blob_ref) and min(tombstone)=max(tombstone)""")
def m1(i: Inputs):
    return merge.resolve_same_content(conf(i))


@query("m2_resolve_add_wins", f"""with g as (select vault_id, file_id,
 max({{'ms':ms,'cnt':cnt,'node':node,'path':path,'ref':blob_ref}}) filter (not tombstone) x,
 max({{'ms':ms,'cnt':cnt,'node':node,'path':path,'ref':blob_ref}}) filter (tombstone) l from conf group by 1,2)
 select vault_id, file_id, x.ref blob_ref, l.node loser_node,
 {COPY.format(p='x.path', m='l.ms', n='l.node')} copy_path, 'tombstone-loses' strategy
 from g where x is not null and l is not null""")
def m2(i: Inputs):
    return merge.resolve_add_wins(conf(i))


@query("m3_resolve_lww", f"""with g as (select file_id, bool_or(tombstone) t,
 max({{'ms':ms,'cnt':cnt,'node':node,'path':path,'ref':blob_ref}}) x from conf group by 1)
 select vault_id, file_id, x.ref winner_ref, blob_ref loser_ref, {COPY.format(p='x.path', m='ms', n='node')} copy_path,
 case when blob_ref in (select blob_id from blobs) then 'lww' else 'lww-lossy' end strategy
 from conf join g using (file_id) where not t and blob_ref<>x.ref""")
def m3(i: Inputs):
    return merge.resolve_lww(settle(conf(i)), i.blobs())


RESOLVED = f"""with r as (select *, row_number() over (partition by file_id order by ms,cnt,node) i,
 count(*) over (partition by file_id) n from conf), f as (select * from r where i=1),
 d as (select r.file_id, min(r.i) di from r join f using (file_id)
 where r.blob_ref<>f.blob_ref or r.tombstone<>f.tombstone group by 1),
 p as (select f.vault_id, f.file_id, di, coalesce(di-1, n) ai from f left join d using (file_id)),
 q as (select p.vault_id, p.file_id, di, a.path ap, a.ms am, a.node an, a.blob_ref ar, a.tombstone ta,
 b.path bp, b.ms bm, b.node bn, b.blob_ref br, b.tombstone tb from p
 join r a on a.file_id=p.file_id and a.i=p.ai left join r b on b.file_id=p.file_id and b.i=p.di),
 z as (select *, case when di is null then 'a' when ta and not tb then 'b' when tb then 'a' else 'b' end win from q),
 y as (select *, case when di is null then '' when win='a' then br else ar end loser_ref,
 case when win='a' then tb else ta end lt, case when win='a' then bm else am end lm,
 case when win='a' then bn else an end ln, case when win='a' then ap else bp end wp,
 case when win='a' then ar else br end wr from z),
 v as (select *, case when di is null then 'same-blob' when lt then 'tombstone-loses'
 when loser_ref<>'' and loser_ref not in (select blob_id from blobs) then 'lww-lossy' else 'lww' end strategy from y)
 select vault_id, file_id, wp path, wr winner_ref, loser_ref, case when strategy in ('same-blob','lww-lossy') then ''
 else {COPY.format(p='wp', m='lm', n='ln')} end copy_path, strategy from v"""


@query("m4_resolve", RESOLVED)
def m4(i: Inputs):
    return merge.resolve(settle(conf(i)), i.blobs())


@query("m4_resolve_rounds", RESOLVED)
def m4_rounds(i: Inputs):
    return merge.resolve(settle(conf(i)), i.blobs(), policy=merge._default_pair).drop("text")


def prop_texts(i: Inputs):
    """Three-line texts per content, which differ in one line."""
    e = i.table("events").select(F.sha2("props", 256).alias("blob_ref"),
                                 F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k")).distinct()
    line = lambda n: F.when(F.col("k") % 3 == n, F.concat(F.lit("edit "), "k")).otherwise(f"line {n}")
    return e.select("blob_ref", F.concat_ws("\n", line(0), F.lit("same"), line(1), F.lit("same too"),
                                            line(2)).alias("text"))


def text_bases(i: Inputs):
    base = i.spark.createDataFrame([("base", "line 0\nsame\nline 1\nsame too\nline 2")],
                                   "blob_ref string, text string")
    return prop_texts(i).unionByName(base)


KEYED = """select sha256(props) ref, any_value(cast(regexp_extract(props,'[0-9]+') as bigint)) k from events group by 1"""


def edited(*e: str) -> str:
    """SQL of the three-line text with the given edits."""
    line = [f"coalesce('edit '||{x}, 'line {n}')" for n, x in enumerate(e)]
    return f"{line[0]}||chr(10)||'same'||chr(10)||{line[1]}||chr(10)||'same too'||chr(10)||{line[2]}"


# Values of a file meet in order: state and next value, until a pair cannot merge.
THREE_WAY = f"""with recursive r as (select c.vault_id, c.file_id, path, ms, cnt, node, blob_ref ref, tombstone t,
 case when x.k%3=0 then x.k end e0, case when x.k%3=1 then x.k end e1, case when x.k%3=2 then x.k end e2,
 blob_ref in (select blob_id from blobs) reach, row_number() over (partition by c.vault_id, c.file_id order by ms,cnt,node) i,
 count(*) over (partition by c.vault_id, c.file_id) n,
 max({{'ms': ms, 'cnt': cnt}}) over (partition by c.vault_id, c.file_id) top from conf c left join ({KEYED}) x on x.ref=c.blob_ref),
 s as (select vault_id, file_id, path, ms, cnt, node, ref, t, e0, e1, e2, reach, i, 'same-blob' strategy, '' loser_ref,
 cast(0 as bigint) loser_ms, '' loser_node, false stop from r where i=1 union all
 select vault_id, file_id, case when win='b' then bp else path end, case win when 'b' then bms when 'm' then top.ms else ms end,
 case win when 'b' then bcnt when 'm' then greatest(top.cnt, cnt)+1 else cnt end, case when win='b' then bnode else node end,
 case win when 'b' then bref when 'm' then sha256({edited('coalesce(e0,b0)', 'coalesce(e1,b1)', 'coalesce(e2,b2)')}) else ref end,
 case win when 'b' then bt when 'm' then false else t end,
 case win when 'b' then b0 when 'm' then coalesce(e0,b0) else e0 end, case win when 'b' then b1 when 'm' then coalesce(e1,b1) else e1 end,
 case win when 'b' then b2 when 'm' then coalesce(e2,b2) else e2 end,
 case win when 'b' then breach when 'm' then true else reach end, bi,
 case kind when 'same' then 'same-blob' when 'tomb' then 'tombstone-loses' when 'merge' then '3-way-merge'
 else case when not (case when win='b' then reach else breach end) then 'lww-lossy' else 'lww' end end,
 case when kind in ('tomb','lww') then case when win='b' then ref else bref end else '' end,
 case when kind in ('tomb','lww') then case when win='b' then ms else bms end else 0 end,
 case when kind in ('tomb','lww') then case when win='b' then node else bnode end else '' end, kind in ('tomb','lww')
 from (select *, case kind when 'merge' then 'm' when 'tomb' then case when t then 'b' else 'a' end
 else case when (ms,cnt,node) >= (bms,bcnt,bnode) then 'a' else 'b' end end win from (select s.*, top, b.path bp, b.ms bms,
 b.cnt bcnt, b.node bnode, b.ref bref, b.t bt, b.e0 b0, b.e1 b1, b.e2 b2, b.reach breach, b.i bi,
 case when s.ref=b.ref and s.t=b.t then 'same' when s.t<>b.t then 'tomb'
 when coalesce(s.e0<>b.e0,false) or coalesce(s.e1<>b.e1,false) or coalesce(s.e2<>b.e2,false) then 'lww' else 'merge' end kind
 from s join r b on b.vault_id=s.vault_id and b.file_id=s.file_id and b.i=s.i+1 where not s.stop)))
 select vault_id, file_id, path, ref winner_ref, loser_ref, case when loser_node<>'' and strategy<>'lww-lossy' then
 {COPY.format(p='path', m='loser_ms', n='loser_node')} else '' end copy_path, strategy,
 case when not t then {edited('e0', 'e1', 'e2')} end text from s
 qualify row_number() over (partition by vault_id, file_id order by i desc)=1"""


@query("m4_resolve_three_way", THREE_WAY)
def m4_texts(i: Inputs):
    c = settle(conf(i))
    base = c.select(*VAULT_KEYS, F.lit("base").alias("base_ref")).distinct()
    return merge.resolve(c, i.blobs(), base, settle(text_bases(i)))


# Contents with an even number are sequences: a common beginning and an entry of their own behind it.
COMMON = "one\ntwo\nthree\n"


def readable_texts(i: Inputs):
    """``(blob_ref, text)`` of the stored contents, and the entries of those that are sequences."""
    stored = i.blobs().select(F.col("blob_id").alias("blob_ref")).distinct()
    texts = settle(prop_texts(i).join(stored, "blob_ref", "left_semi").join(
        i.table("events").select(F.sha2("props", 256).alias("blob_ref"),
                                 F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k")).distinct(), "blob_ref")
        .select("blob_ref", F.when(F.col("k") % 2 == 0, COMMON + "+").otherwise(F.col("text")).alias("text"), "k"))
    even = texts.where("k % 2 = 0").select("blob_ref")
    seeds = text.seed_sequence(even.withColumn("text", F.lit(COMMON)), "blob_ref").withColumnRenamed("file_id", "blob_ref")
    own = even.select("blob_ref", F.lit(1).cast("long").alias("ms"), F.lit(1).cast("long").alias("cnt"),
                      F.substring("blob_ref", 1, 12).alias("node"), F.lit(0).cast("long").alias("p_ms"),
                      F.lit(len(COMMON)).cast("long").alias("p_cnt"), F.lit(text.SEED).alias("p_node"),
                      F.lit("R").alias("side"), F.lit("+").alias("value"), F.lit(False).alias("deleted"))
    return texts.drop("k"), seeds.unionByName(own)


ROUTED = f"""with k as ({KEYED}), tx as (select ref, k, case when k%2=0 then 'one'||chr(10)||'two'||chr(10)||'three'||chr(10)||'+'
 else {edited('case when k%3=0 then k end', 'case when k%3=1 then k end', 'case when k%3=2 then k end')} end txt
 from k where ref in (select blob_id from blobs)),
 x as (select vault_id, file_id, c.tombstone, tx.ref, tx.k, txt from conf c left join tx on tx.ref=c.blob_ref and not c.tombstone
 where {IS_TEXT}),
 g as (select vault_id, file_id, count(ref) live, count(distinct ref) refs, bool_and(k%2=0) even, any_value(txt) one from x group by 1,2),
 o as (select *, case when live=0 then 'fugue-tombstone' when live>=2 and refs>1 and not even then 'text-union' else 'fugue-join' end strategy,
 case when even then 'one'||chr(10)||'two'||chr(10)||'three'||chr(10)||repeat('+', cast(refs as int)) else one end joined from g)"""


@query("m9_resolve_text", f"""{ROUTED}, l as (select distinct vault_id, file_id, unnest(string_split(case when strategy='text-union'
 then txt else joined end, chr(10))) line from o join x using (vault_id, file_id) where strategy<>'fugue-tombstone' and ref is not null)
 select o.vault_id, o.file_id, strategy, case when strategy='fugue-join' then sha256(joined) else '' end winner_ref,
 sha256(coalesce(string_agg(line, chr(10) order by line), '')) lines_sha from o left join l on l.vault_id=o.vault_id
 and l.file_id=o.file_id group by all""")
def m9_text(i: Inputs):
    texts, sequences = readable_texts(i)
    out = merge.resolve_text(settle(conf(i)), texts, sequences)
    lines = F.array_join(F.sort_array(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n"))), "\n")
    return out.select(*VAULT_KEYS, "strategy", "winner_ref", F.sha2(lines, 256).alias("lines_sha"))


@query("m5_resolution_report", f"""{ROUTED} select strategy, count(*) files, count(*) filter (strategy='lww-lossy') data_loss
 from (select strategy from o union all select strategy from ({RESOLVED}) b where not exists
 (select 1 from o where o.vault_id=b.vault_id and o.file_id=b.file_id)) group by 1""")
def m5(i: Inputs):
    texts, sequences = readable_texts(i)
    return merge.resolution_report(merge.resolve_files(settle(conf(i)), i.blobs(), texts, sequences))


@query("m6_three_way_text", """select conv_id file_id, 'ours first'||chr(10)||body||chr(10)||'theirs last' merged from
 (select conv_id, string_agg(text, chr(10) order by turn) body from conversations group by 1)""")
def m6(i: Inputs):
    base = i.table("conversations").groupBy(F.col("conv_id").alias("file_id")).agg(
        F.expr("listagg(text, '\n') within group (order by turn)").alias("base"))
    return text.three_way_text(base.withColumn("a", F.concat(F.lit("ours first\n"), "base")).withColumn(
        "b", F.concat("base", F.lit("\ntheirs last"))))


@query("m7_line_union", """select file_id, count(distinct line) lines from (select file_id,
 unnest(string_split(body, chr(10))) line from versions) group by 1""")
def m7(i: Inputs):
    union = text.line_union(i.versions().select("file_id", "body"))
    return union.select("file_id", F.explode(F.split("body", "\n")).alias("line")).groupBy(
        "file_id").agg(F.countDistinct("line").alias("lines"))


@query("m7_line_union_text")
def m7_text(i: Inputs):
    return text.line_union(i.versions().select("file_id", "body"))


SHARES = """select file_id, bool_or(a) and not bool_or(a and b) shares from (select file_id, dot,
 count(distinct version)>1 a, count(distinct val)>1 b from dots group by 1,2) group by 1"""


@query("m8_shares_history", SHARES)
def m8(i: Inputs):
    return merge.shares_history(i.dots())


@query("m9_text_strategy", f"""with x as (select vault_id, file_id, count(*) n_values, count(*) filter (not tombstone
 and blob_ref in (select blob_id from blobs)) live from conf where {IS_TEXT} group by 1,2)
 select vault_id, file_id, n_values, live, case when live=0 then 'fugue-tombstone'
 when live>=2 and cast(substr(file_id,2) as int)%3<>0 then 'text-union' else 'fugue-join' end strategy from x""")
def m9(i: Inputs):
    c = settle(conf(i))
    shares = c.select(*VAULT_KEYS).distinct().withColumn(
        "shares", F.substring("file_id", 2, 9).cast("int") % 3 == 0)
    return merge.text_strategy(c, i.blobs().withColumnRenamed("blob_id", "blob_ref"), shares)


@query("m10_seed_sequence", """select doc_id file_id, count(*) n, min(i) first_cnt, max(i) last_cnt,
 count(*) filter (i=1) roots, sha256(string_agg(ch[i], '' order by i)) hash from (select doc_id, ch,
 unnest(range(1, len(ch)+1)) i from (select doc_id, string_split(text,'') ch from documents)) group by 1""")
def m10(i: Inputs):
    return text.sequence_digest(text.seed_sequence(i.table("documents"), "doc_id"))


def dot_entries(i: Inputs, version: int):
    d = i.dots().where(F.col("version") == version)
    up = F.col("dot") > 1
    zero = F.lit(0).cast("long")
    return d.select(
        "file_id", zero.alias("ms"), F.col("dot").alias("cnt"), F.lit("seed").alias("node"),
        F.when(up, zero).alias("p_ms"), F.when(up, F.col("dot") - 1).alias("p_cnt"),
        F.when(up, "seed").alias("p_node"), F.lit("R").alias("side"), F.col("val").alias("value"),
        ((F.col("version") == 1) & (F.col("dot") % 17 == 0)).alias("deleted"))


@query("m11_sequence_join", """select file_id, count(*) n, count(*) filter (gone) deleted, max(dot) last_dot from
 (select file_id, dot, bool_or(version=1 and dot%17=0) gone from dots group by 1,2) group by 1""")
def m11(i: Inputs):
    j = text.sequence_join(dot_entries(i, 0), dot_entries(i, 1))
    return j.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("deleted").alias("deleted"),
                                    F.max("cnt").alias("last_dot"))


@query("m12_sequence_text", """select file_id, string_agg(val, '' order by dot) text from (select file_id, dot,
 min(val) val, bool_or(version=1 and dot%17=0) gone from dots group by 1,2) where not gone group by 1""")
def m12(i: Inputs):
    return text.sequence_text(text.sequence_join(dot_entries(i, 0), dot_entries(i, 1)))


def url_tree(i: Inputs, deleted):
    """Characters of every page address as a binary tree: parent i div 2, even ones left."""
    d = i.table("pages").select(F.col("page_id").alias("file_id"), F.posexplode(
        F.split("url", "")).alias("_i", "value")).withColumn("cnt", (F.col("_i") + 1).cast("long"))
    up, zero = F.col("cnt") > 1, F.lit(0).cast("long")
    return d.select("file_id", zero.alias("ms"), "cnt", F.lit("x").alias("node"),
                    F.when(up, zero).alias("p_ms"), F.when(up, F.expr("cnt div 2")).alias("p_cnt"),
                    F.when(up, "x").alias("p_node"),
                    F.when(F.col("cnt") % 2 == 0, "L").otherwise("R").alias("side"), "value",
                    deleted.alias("deleted"))


@query("m12_tree_text", """select file_id, string_agg(val, '' order by replace(substr(bin(i),2),'1','2')||'1') text
 from url_tree where i%5<>0 group by 1""")
def m12_tree(i: Inputs):
    return text.sequence_text(url_tree(i, F.col("cnt") % 5 == 0))


@query("m12_partial_text", """with kept as (select *, list_min(list_filter(range(1, length(bin(i))),
 lambda k: (i >> k::int) % 7 = 3)) k from url_tree where i%7<>3), placed as (select file_id, val, i,
 case when k is null then 1 else i >> (k-1)::int end r from kept)
 select file_id, string_agg(val, '' order by r, replace(substr(bin(i),length(bin(r))+1),'1','2')||'1') text
 from placed group by 1""")
def m12_partial(i: Inputs):
    """Sequences of which a seventh has not arrived."""
    return text.sequence_text(url_tree(i, F.lit(False)).where("cnt % 7 <> 3"))


@query("m13_text_edits", """select a.file_id, case when a.body=b.body then 'noop' when a.body='' then 'seed'
 when (length(a.body)+length(b.body))*abs(length(b.body)-length(a.body))>5000000 then 'reseed' else 'edit' end "action"
 from versions a join versions b on a.file_id=b.file_id and a.version='A' and b.version='B'""")
def m13(i: Inputs):
    return text.text_edits(version_pairs(i), text.DIFF_BUDGET)[0]


def version_pairs(i: Inputs):
    v = i.versions()
    old = v.where("version = 'A'").select("file_id", F.col("body").alias("old"))
    return old.join(v.where("version = 'B'").select("file_id", F.col("body").alias("new")), "file_id")


@query("m13_edit_rows", """select a.file_id, cast(length(b.body)-length(a.body) as bigint) growth
 from versions a join versions b on a.file_id=b.file_id and a.version='A' and b.version='B'
 where a.body<>b.body and a.body<>'' and
 (length(a.body)+length(b.body))*abs(length(b.body)-length(a.body))<=5000000""")
def m13_rows(i: Inputs):
    edits = text.text_edits(version_pairs(i), text.DIFF_BUDGET)[1]
    return edits.groupBy("file_id").agg(F.sum(F.when(F.col("op") == "ins", 1).otherwise(-1)).alias("growth"))


@query("m14_prune_tombstones", """with d as (select *, i%3=0 and i<=case file_id%3 when 0 then 40 when 1 then 15 else 0 end dropped
 from url_tree),
 kept as (select distinct a.file_id, a.i from d a where exists (select 1 from d b where b.file_id=a.file_id
 and not b.dropped and starts_with(bin(b.i), bin(a.i))))
 select 'v'||(file_id%3) vault_id, file_id, count(*) dropped from (select file_id, i from d except
 select file_id, i from kept) group by 1, 2""")
def m14(i: Inputs):
    entries = url_tree(i, F.col("cnt") % 3 == 0).withColumn("vault_id", F.concat(F.lit("v"), F.col("file_id") % 3))
    frontier = i.spark.createDataFrame([("v0", "x", 0, 40), ("v1", "x", 0, 15)],
                                       "vault_id string, node string, ms bigint, cnt bigint")
    return text.prune_report(entries, text.prune_tombstones(entries, frontier))


@query("m15_repair", f"""select count(*) total, count(*) repaired, cast(0 as bigint) failed,
 cast(sum(length(content)) as bigint) chars from snapshot where {NOT_HIDDEN} and {IS_TEXT}""")
def m15(i: Inputs):
    seeds, report = text.repair(i.snapshot())
    chars = seeds.agg(F.count(F.lit(1)).alias("chars"), F.lit(1).alias("_k"))
    return report.withColumn("_k", F.lit(1)).join(chars, "_k").drop("_k")


# S -------------------------------------------------------------------------------------
@query("s1_flatten_json", """select cast(doc as varchar) doc, path, val from (select doc,
 unnest(['["a","b"]','["a","c","k"]','["z"]']) path,
 unnest(['[2,1]', regexp_extract(props,'[0-9]+'), cast(doc as varchar)]) val from nested)""")
def s1(i: Inputs):
    return settings.flatten_json(nested(i))


@query("s2_unflatten", """select cast(doc as varchar) doc, '{"a":{"b":[2,1],"c":'||replace(props,' ','')||'},"z":'||doc||'}'
 json from nested""")
def s2(i: Inputs):
    return settings.unflatten(settings.flatten_json(nested(i)))


def timed_leaves(i: Inputs):
    return i.leaves().withColumn("cnt", F.col("event_id"))


STATE = """lstate as (select doc, path, max_by(val,(ms,event_id,node)) val, max_by(present,(ms,event_id,node)) present
 from leaves group by 1,2)"""


@query("s3_field_map_diff", f"""with {STATE}, s as (select doc, path, case when length(val)%2=0 then val else 'changed' end val
 from lstate where length(doc)%2=0 union all select distinct doc, 'extra', 'null' from lstate)
 select coalesce(h.doc,s.doc) doc, coalesce(h.path,s.path) path, coalesce(s.val,'') val, s.doc is not null present
 from (select * from lstate where present) h full join s on h.doc=s.doc and h.path=s.path
 where s.doc is null or h.doc is null or h.val<>s.val""")
def s3(i: Inputs):
    state = settle(settings.field_map_state(timed_leaves(i)))
    snap = state.where(F.length("doc") % 2 == 0).select("doc", "path", F.when(
        F.length("val") % 2 == 0, F.col("val")).otherwise("changed").alias("val"))
    extra = state.select("doc", F.lit("extra").alias("path"), F.lit("null").alias("val")).distinct()
    return settings.field_map_diff(state, snap.unionByName(extra)).fillna("", ["val"])


@query("s4_field_map_merge", f"with {STATE} select doc, path, val from lstate where present")
def s4(i: Inputs):
    return settings.field_map_merge(timed_leaves(i)).select("doc", "path", "val")


MEMBERS = """members as (select distinct sid, elem from orset_adds a where not exists
 (select 1 from orset_removed r where r.sid=a.sid and r.elem=a.elem and r.dot=a.dot))"""


@query("s5_orset_diff", f"""with {MEMBERS}, snap as (select distinct sid, elem from orset_adds where elem<>'view')
 select coalesce(m.sid,s.sid) sid, coalesce(m.elem,s.elem) elem, case when m.sid is null then 'add' else 'remove' end op
 from members m full join snap s on m.sid=s.sid and m.elem=s.elem where m.sid is null or s.sid is null""")
def s5(i: Inputs):
    members = settings.orset_merge(i.orset_adds(), i.orset_removed())
    return settings.orset_diff(members, i.orset_adds().where("elem <> 'view'"))


@query("s6_orset_merge", f"with {MEMBERS} select sid, elem from members")
def s6(i: Inputs):
    return settings.orset_merge(i.orset_adds(), i.orset_removed())


@query("s7_orset_render", f"""with {MEMBERS} select sid, '['||string_agg('"'||elem||'"', ',' order by elem)||']' members
 from members group by 1""")
def s7(i: Inputs):
    return settings.orset_render(i.orset_adds(), i.orset_removed())


@query("s8_whole_file_merge", """select doc, max(ms) ms, max_by(val,(ms,event_id,node)) content from leaves group by 1""")
def s8(i: Inputs):
    v = timed_leaves(i).withColumnRenamed("val", "content")
    return settings.whole_file_merge(v).select("doc", "ms", "content")


@query("s8_whole_file_diff", """with t as (select doc, max_by(val,(ms,event_id,node)) content from leaves where present
 group by 1), n as (select doc, max_by(val,(ms,event_id,node)) content from leaves group by 1)
 select n.doc, n.content from n left join t using (doc) where t.content is distinct from n.content""")
def s8_diff(i: Inputs):
    v = timed_leaves(i).withColumnRenamed("val", "content")
    state = settings.whole_file_merge(v.where("present"))
    return settings.whole_file_diff(state, settings.whole_file_merge(v)).select("doc", "content")


@query("s9_orset_pull", """with a as (select distinct sid, elem from orset_adds where dot%2=0),
 b as (select distinct sid, elem from orset_adds x where not exists (select 1 from orset_removed r
 where r.sid=x.sid and r.elem=x.elem and r.dot=x.dot)), d as (select coalesce(a.sid,b.sid) sid from a full join b
 on a.sid=b.sid and a.elem=b.elem where a.sid is null or b.sid is null)
 select sid, sid in (select sid from d) changed from (select sid from orset_adds where dot%2=1 union
 select sid from orset_removed)""")
def s9_sets(i: Inputs):
    adds, gone = i.orset_adds(), i.orset_removed()
    return settings.orset_pull(adds.where("dot % 2 = 0"), gone.where("false"),
                               adds.where("dot % 2 = 1"), gone)[1]


def pulled(i: Inputs):
    """Leaf writes split into what a device holds and what it pulls."""
    rows = timed_leaves(i).withColumn("record_id", F.col("event_id")).withColumn(
        "envelope", F.when(F.col("path") == "error", "foreign").otherwise("settings"))
    return rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")


PULLED = """ours as (select * from leaves where event_id%2=1 and path<>'error' and doc not like '%7'),
 t as (select doc, count(distinct event_id) records from ours group by 1),
 b as (select doc, path, max_by(val,(ms,event_id,node)) val, max_by(present,(ms,event_id,node)) present
 from leaves where event_id%2=0 and doc in (select doc from t) group by 1,2),
 a as (select doc, path, max_by(val,(ms,event_id,node)) val, max_by(present,(ms,event_id,node)) present from
 (select doc, path, val, present, ms, event_id, node from ours union all select doc, path, val, present, ms, event_id, node
 from leaves where event_id%2=0 and doc in (select doc from t)) group by 1,2)"""


@query("s9_settings_pull", f"""with {PULLED}, x as (select distinct coalesce(p.doc,q.doc) doc from
 (select * from b where present) p full join (select * from a where present) q on p.doc=q.doc and p.path=q.path
 where p.val is distinct from q.val) select doc, records, doc in (select doc from x) changed,
 records>1 needs_compaction from t""")
def s9(i: Inputs):
    held, remote_rows = pulled(i)
    kind = F.when(~F.col("doc").endswith("7"), F.lit("fieldMap"))
    return settings.settings_pull(held, remote_rows, kind)[1]


@query("u3_resource_classifier", f"with {PULLED} select doc, path, val, present from a")
def u3(i: Inputs):
    held, remote_rows = pulled(i)
    kind = F.when(~F.col("doc").endswith("7"), F.lit("fieldMap"))
    return settings.settings_pull(held, remote_rows, kind)[0].select("doc", "path", "val", "present")


# H -------------------------------------------------------------------------------------
def heads(i: Inputs):
    return i.kept("heads", lambda: retention.upsert_heads(i.head_reports()))


def plan(i: Inputs):
    h = with_state_columns(i.history())
    return i.kept("plan", lambda: retention.retention_plan(h, heads(i), NOW_MS, 10))


@query("h1_upsert_heads", "select * from heads")
def h1(i: Inputs):
    return retention.upsert_heads(i.head_reports())


@query("h2_fresh_heads", f"""select vault_id, device, updated_ms >= {NOW_MS}-7776000000 fresh from heads""")
def h2(i: Inputs):
    fresh, stale = retention.fresh_heads(heads(i), NOW_MS)
    row = lambda df, f: df.select("vault_id", "device", F.lit(f).alias("fresh"))
    return row(fresh, True).unionByName(row(stale, False))


@query("h3_safe_head", "select * from safe")
def h3(i: Inputs):
    return retention.safe_head(heads(i), NOW_MS)


@query("h4_retention_plan", """select event_id, reason, case when reason='expired' then 'delete' else 'keep' end "action"
 from retained""")
def h4(i: Inputs):
    h = with_state_columns(i.history())
    return retention.retention_plan(h, heads(i), NOW_MS, 10).select("event_id", "reason", "action")


@query("h5_retention_summary", """select vault_id, count(*) total, count(*) filter (reason='expired') deleted,
 count(*) filter (reason<>'expired') kept, count(*) filter (reason='protected') protected_by_head,
 coalesce(min(created_ms) filter (reason='expired'),0) oldest_deleted,
 coalesce(max(created_ms) filter (reason='expired'),0) newest_deleted,
 coalesce(min(created_ms) filter (reason<>'expired'),0) oldest_kept,
 coalesce(max(created_ms) filter (reason<>'expired'),0) newest_kept,
 max(active_devices) active_devices from retained group by 1""")
def h5(i: Inputs):
    return retention.retention_summary(plan(i)).fillna(0)


@query("h6_orphan_blobs", "select vault_id, ref from gone_refs")
def h6(i: Inputs):
    return retention.orphan_blobs(plan(i), i.registers(), i.sync_base())


@query("h7_cache_gc", """select vault_id, blob_id from vault_blobs where store='local'
 and (vault_id, blob_id) not in (select (vault_id, ref) from pins)""")
def h7(i: Inputs):
    return retention.cache_gc(local(i), i.registers(), i.sync_base()).select("vault_id", "blob_id")


@query("h7_cache_gc_report", """select count(*) scanned, count(*) filter ((vault_id, blob_id) not in
 (select (vault_id, ref) from pins)) deleted from vault_blobs where store='local'""")
def h7_report(i: Inputs):
    gone = retention.cache_gc(local(i), i.registers(), i.sync_base())
    return retention.cache_gc_report(local(i), gone)


@query("h8_apply_retention", """select 'blob' kind, count(*) left_over from vault_blobs
 where (vault_id, blob_id) not in (select (vault_id, ref) from gone_refs)
 union all select 'event', count(*) from retained where reason<>'expired'""")
def h8(i: Inputs):
    p = plan(i)
    orphans = settle(retention.orphan_blobs(p, i.registers(), i.sync_base()))
    left, events = retention.apply_retention(p, orphans, i.vault_blobs())
    n = F.count(F.lit(1)).alias("left_over")
    return left.agg(n).select(F.lit("blob").alias("kind"), "left_over").unionByName(
        events.agg(n).select(F.lit("event").alias("kind"), "left_over"))


@query("h9_delete_events", """select event_id, op='delete' or k<5 found from history""")
def h9(i: Inputs):
    h = i.history()
    ids = h.where("op = 'delete' or k < 5").select("event_id")
    ids = ids.unionByName(ids.select(-1 - F.col("event_id")).toDF("event_id")).unionByName(ids)
    rest, found = retention.delete_events(h, ids)
    return rest.select("event_id", F.lit(False).alias("found")).unionByName(
        found.select("event_id", F.lit(True).alias("found")))


@query("h10_stability_frontier", f"""with a as (select * from heads where {NOW_MS}-updated_ms < 7776000000),
 n as (select vault_id, count(*) n from a group by 1), s as (select x.vault_id, x.node, count(*) d, min(x.h) h
 from head_ctx x join a using (vault_id, device) group by 1,2)
 select s.vault_id, node, h.ms ms, h.cnt cnt from s join n on n.vault_id=s.vault_id and d=n""")
def h10(i: Inputs):
    return retention.stability_frontier(heads(i), i.head_ctx(), NOW_MS)


@query("h11_file_versions", """select event_id, file_id, ms, op from history where file_id in
 (select file_id from conf where path like '%.md')""")
def h11(i: Inputs):
    ids = conf(i).where("path like '%.md'").select("file_id")
    return retention.file_versions(i.history(), ids).select("event_id", "file_id", "ms", "op")


@query("h11_path_versions", """select event_id, ms from history where file_id='f7' order by ms desc""")
def h11_path(i: Inputs):
    from ..functions.paths import file_id

    h = i.history().withColumn("file_id", F.when(F.col("file_id") == "f7", file_id(
        VAULT_UUID, F.lit("notes/seven.md"))).otherwise(F.col("file_id")))
    vaults = h.select("vault_id").distinct().withColumn("vault_uuid", F.lit(VAULT_UUID))
    return retention.path_versions(h, vaults, "notes/seven.md").select("event_id", "ms")


@query("h12_content_at", """select h.event_id, case when h.tombstone or k%10=4 then '' else sha256(props) end hash
 from history h join events using (event_id)""")
def h12(i: Inputs):
    manifests, chunks = prop_manifests(i)
    out = retention.content_at(i.history(), manifests, chunks)
    return out.select("event_id", F.coalesce(F.sha2("content", 256), F.lit("")).alias("hash"))


@query("h13_restore_versions", f"""with p as (select * from history where blob_ref<>'' qualify row_number() over
 (partition by file_id order by ms desc, cnt desc, node desc)=1), t as (select vault_id, max(ms) ms from history group by 1)
 select event_id, p.vault_id, blob_ref, greatest({NOW_MS-86400000}, t.ms+1) ms,
 row_number() over (partition by p.vault_id order by event_id) cnt, 'restorer' node from p join t using (vault_id)""")
def h13(i: Inputs):
    h = i.history()
    picks = first_per_key(h.where("blob_ref <> ''"), VAULT_KEYS, [hlc().desc()])
    return retention.restore_versions(picks, h, NOW_MS - 86400000, "restorer").select(
        "event_id", "vault_id", "blob_ref", "ms", "cnt", "node")


# The fold ends at the first value that differs from the oldest one: values before it agree.
@query("u1_conflict_policy", """with r as (select *, row_number() over (partition by vault_id, file_id order by ms,cnt,node) i from conf),
 d as (select r.vault_id, r.file_id, min(r.i) filter (r.blob_ref<>f.blob_ref) di from r join r f on f.vault_id=r.vault_id
 and f.file_id=r.file_id and f.i=1 group by 1,2)
 select d.vault_id, d.file_id, case when di is null then 'same-blob' when a.tombstone or b.tombstone then 'remove-wins'
 else 'newest' end strategy, case when di is null then a.blob_ref when a.tombstone then a.blob_ref else b.blob_ref end winner_ref
 from d join r a on a.vault_id=d.vault_id and a.file_id=d.file_id and a.i=1
 left join r b on b.vault_id=d.vault_id and b.file_id=d.file_id and b.i=di""")
def u1(i: Inputs):
    def remove_wins(ours, theirs, base):
        if ours["blob_ref"] == theirs["blob_ref"]:
            return {"winner": "theirs", "strategy": "same-blob"}
        if ours["tombstone"] or theirs["tombstone"]:
            return {"winner": "ours" if ours["tombstone"] else "theirs", "strategy": "remove-wins"}
        return {"winner": "theirs", "strategy": "newest"}

    out = merge.resolve(settle(conf(i)), i.blobs(), policy=remove_wins)
    return out.select(*VAULT_KEYS, "strategy", "winner_ref")


@query("u4_chunk_table_function", """select cast(doc_id as varchar) file_id, cast(0 as bigint) first_off,
 strlen(text) covered from documents where text<>''""")
def u4(i: Inputs):
    chunks = blobs.cdc_chunks(corpus(i), **CHUNK)
    return chunks.groupBy("file_id").agg(F.min("off").alias("first_off"),
                                         F.max(F.col("off") + F.col("size")).alias("covered"))
