"""DuckDB text of the test inputs, derived from the driver tables (see FIXTURES.md)."""

import re

FIXTURES: dict[str, str] = {
    "w": """
select event_id, 'v'||(user_id%4) vault_id, 'f'||user_id file_id, 'd'||(event_id%3) node,
  (epoch_us(ts)//1000) ms,
  row_number() over (partition by user_id, (epoch_us(ts)//1000) order by event_id)-1 cnt,
  row_number() over (partition by user_id order by ts, event_id) rn,
  row_number() over (partition by user_id%4 order by ts, event_id) server_seq,
  (event_id*7)%5 lag, event_type='error' tombstone,
  case when event_type='error' then '' else sha256(props) end blob_ref,
  cast(regexp_extract(props,'[0-9]+') as bigint) k,
  cast(round(value*100) as bigint) size_bytes
from events
""",
    "c": """
select a.event_id, a.file_id, b.node, max({'ms':b.ms,'cnt':b.cnt}) h
from w a join w b on a.file_id=b.file_id and b.rn<a.rn and (b.node=a.node or b.rn<a.rn-a.lag)
group by 1,2,3
""",
    "surv": """
with fr as (select file_id,node,max(h) h from c group by 1,2)
select w.* from w left join fr on fr.file_id=w.file_id and fr.node=w.node
where fr.h is null or fr.h < {'ms':w.ms,'cnt':w.cnt}
""",
    "arr": """
select w.*, row_number() over (partition by file_id order by rn+(event_id*13)%11, rn) arrival from w
""",
    "refs": """
select event_id, vault_id, file_id, blob_ref ref from w where not tombstone
union all select event_id, vault_id, file_id, 'c'||k from w where not tombstone
union all select event_id, vault_id, file_id, 'c'||((k*7)%100) from w where not tombstone
""",
    "head_reports": """
select vault_id, node device, event_id arrival, greatest(server_seq-(event_id%40),0) head_seq,
  case when vault_id='v3' and node='d2' then ms-8640000000 else ms end updated_ms
from w
""",
    "head_ctx": """
with h as (select vault_id, device, max(head_seq) head_seq from head_reports group by 1,2)
select h.vault_id, h.device, w.node, max({'ms':w.ms,'cnt':w.cnt}) h
from h join w on w.vault_id=h.vault_id and w.server_seq<=h.head_seq
where not (h.vault_id='v2' and h.device='d1') group by 1,2,3
""",
    "history": """
select event_id, vault_id, file_id, node, ms, cnt, server_seq, ms created_ms, blob_ref, k, tombstone,
  case when tombstone then 'delete' when rn=1 then 'create' else 'modify' end op from w
""",
    "blobs": """
select distinct 'c'||k blob_id, 'remote' store from w where k%10<>3
union all select distinct sha256(props), 'remote' from events where cast(regexp_extract(props,'[0-9]+') as bigint)%10<>4
union all select distinct 'c'||k, 'local' from w where k%3<>0
union all select 'x'||i, 'local' from range(20) t(i)
""",
    "vault_blobs": """
select distinct vault_id, 'c'||k blob_id, 'remote' store from w where (k+cast(substr(vault_id,2) as bigint))%10<>3
union all select distinct vault_id, blob_ref, 'remote' from w where (k+cast(substr(vault_id,2) as bigint))%10<>4 and blob_ref<>''
union all select distinct vault_id, 'c'||k, 'local' from w where (k+cast(substr(vault_id,2) as bigint))%3<>0
union all select 'v'||(i%4), 'x'||i, 'local' from range(20) t(i)
""",
    "sync_base": """
select file_id, max_by(blob_ref, rn) blob_ref from w
where rn<=40 and not tombstone and cast(substr(file_id,2) as bigint)%3<>0 group by 1
""",
    "snapshot": """
select case when doc_id%50=0 then '.trash/' else '' end||source||'/'||doc_id||
  (['.md','.png','.txt','','.PDF'])[cast(doc_id%5 as int)+1] path,
  doc_id*1000 mtime, strlen(text) size, text content, sha256(text) hash from documents
""",
    "prior": """
select path, case when mtime%3000=0 then sha256(content||'x') else hash end chunk,
  size + case when mtime%7000=0 then 1 else 0 end size_bytes, mtime%11000=0 tombstone
from snapshot where mtime%4000<>0
union all select 'gone/'||i||'.md', 'c'||i, i, false from range(50) t(i)
""",
    "versions": """
select conv_id file_id, case when role='assistant' then 'A' else 'B' end version,
  string_agg(text, chr(10) order by turn) body from conversations group by 1,2
""",
    "leaves": """
select 'u'||user_id doc, event_type path, props val, value>=10 present, ts, (epoch_us(ts)//1000) ms, event_id,
  'd'||(event_id%3) node from events
""",
    "orset_adds": """
select 's'||(user_id%50) sid, event_type elem, event_id dot from events where event_id%3<>0
""",
    "orset_removed": """
select distinct a.sid, a.elem, a.dot from orset_adds a join events r
  on 's'||(r.user_id%50)=a.sid and r.event_type=a.elem and r.event_id%3=0 and a.dot<r.event_id-2
""",
    "users": """
select c_custkey user_id, lower(c_name)||'@example.com' email,
  case when c_custkey%100=0 then 'admin' else 'user' end role, c_nationkey, c_mktsegment from customer
""",
    "plans": """
select * from (values ('1-URGENT',49900,365,true,false,10,104857600,5368709120,'paid'),
 ('2-HIGH',29900,90,true,true,5,52428800,1073741824,'paid'),
 ('3-MEDIUM',9900,30,true,false,1,10485760,52428800,'paid'),
 ('4-NOT SPECIFIED',0,14,true,false,1,10485760,52428800,'trial'),
 ('5-LOW',0,30,false,true,null,null,null,'promo'))
 t(plan_id,amount_kopecks,period_days,managed,external,max_vaults,max_file,quota,acquisition)
""",
    "subs": """
select o_orderkey sub_id, o_custkey user_id, o_orderpriority plan_id, o_orderstatus status,
  o_orderdate started, o_orderdate + to_days(cast(p.period_days as int)) ends,
  cast(round(o_totalprice*100) as bigint) amount_kopecks
from orders join plans p on p.plan_id=o_orderpriority
""",
    "codes": """
select 'CODE-'||p_partkey code, case when p_partkey%2=0 then 5+p_size end percent,
  case when p_partkey%2=1 then cast(round(p_retailprice*100) as bigint) end kopecks,
  case when p_partkey%4=0 then 500000 end max_discount,
  case when p_partkey%3=0 then 2000000 end min_order,
  case when p_partkey%5=0 then '3-MEDIUM' end only_plan,
  case when p_partkey%97=0 then p_partkey%1500 end only_user,
  case when p_partkey%7=0 then 20 end max_redemptions, 1+p_partkey%2 max_per_user,
  p_partkey%13<>0 is_active, p_brand campaign,
  case when p_partkey%6=0 then timestamp '1997-01-01' end starts_at,
  case when p_partkey%8=0 then timestamp '2000-06-01' end expires_at from part
""",
    "checkouts": """
select row_number() over (order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) seq,
  l_orderkey order_id, o_custkey user_id, 'code-'||l_partkey typed_code,
  o_orderpriority plan_id, cast(round(l_extendedprice*100) as bigint) original_kopecks, l_shipdate at_ts
from lineitem join orders on o_orderkey=l_orderkey
""",
    "rejections": """
select event_id, case event_type when 'error' then 'app_policy.quota.storage:current='||event_id||',limit=5000'
  when 'click' then 'RpcException: UNAUTHENTICATED' when 'view' then 'PAYMENT_REQUIRED for user'
  when 'signup' then 'permission_denied: vault' else 'socket closed' end msg from events
""",
    "file_events": """
select event_id, ts, 'd'||(user_id%3) device, 'n'||(user_id%40)||'.md' path,
  case event_type when 'view' then 'typing' when 'click' then 'modified' when 'signup' then 'created'
    when 'purchase' then 'moved' else 'deleted' end kind,
  case when event_type='purchase' and event_id%4<>0 then 'old'||(user_id%40)||'.md' end old_path from events
""",
    "blob_chunks": """
select l_orderkey blob_id, l_linenumber off, cast(round(l_quantity) as bigint) len, l_shipdate ts from lineitem
""",
    "fixed_chunks": """
select doc_id, i ord, substr(text, cast(i*256+1 as bigint), 256) piece, sha256(substr(text, cast(i*256+1 as bigint), 256)) hash
from (select doc_id, text, unnest(range((length(text)+255)//256)) i from documents)
""",
    "biz": """
select ts, user_id, case event_type when 'signup' then 'user.registered' when 'click' then 'user.signed_in'
  when 'view' then 'sync.session_started' when 'purchase' then 'payment.completed' else 'vault.created' end name,
  case when event_type='purchase' then cast(round(value*100) as bigint) end amount_kopecks from events
""",
    "dots": """
select doc_id//2 file_id, doc_id%2 version, i dot, ch[i] val
from (select doc_id, ch, unnest(range(1, len(ch)+1)) i from (select doc_id, string_split(text,'') ch from documents))
""",
    "paths": """
select event_id, (['app.json','.obsidian/appearance.json','workspace.json','community-plugins.json',
 'plugins/p'||(event_id%9)||'/data.json','plugins/p1/main.js','themes/t'||(event_id%4)||'/theme.css',
 'snippets/a.css','snippets/a.txt','daily-notes.json','../x.json','x.sqlite'])[cast(event_id%12 as int)+1] path from events
""",
}


def with_fixtures(body: str) -> str:
    """Prefix ``body`` with the CTEs it mentions, in definition order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for name, sql in FIXTURES.items():
            if name in words and name not in needed:
                needed.add(name)
                todo.append(sql)
    ctes = ",\n".join(f"{n} as ({FIXTURES[n].strip()})" for n in FIXTURES if n in needed)
    if not ctes:
        return body
    body = body.strip()
    for start in ("with recursive ", "with "):
        if body.startswith(start):
            return f"{start}{ctes},\n{body.removeprefix(start)}"
    return f"with {ctes}\n{body}"



# Inputs built from the ones above.
FIXTURES.update({
    "reg": """select *, 'notes/'||file_id||case when cast(substr(file_id,2) as bigint)%2=0
 then '.md' else '.png' end path from surv""",
    "regrefs": """select vault_id, file_id, blob_ref ref from reg where not tombstone
 union all select vault_id, file_id, 'c'||k from reg where not tombstone
 union all select vault_id, file_id, 'c'||((k*7)%100) from reg where not tombstone""",
    "conf": "select * from reg where file_id in (select file_id from reg group by 1 having count(*)>1)",
    "heads": """select vault_id, device, max_by(head_seq, arrival) head_seq,
 max_by(updated_ms, arrival) updated_ms from (select *, max(head_seq) over (
 partition by vault_id, device order by arrival) top from head_reports)
 where head_seq>=top group by 1,2""",
    "safe": """select vault_id, min(head_seq) filter (1706659200000-updated_ms<=2592000000) safe_seq,
 count(*) filter (1706659200000-updated_ms<=2592000000) active_devices from heads group by 1""",
    "retained": """select h.*, coalesce(active_devices,0) active_devices,
 case when created_ms >= 1706659200000-864000000 then 'young'
 when server_seq > safe_seq then 'protected' else 'expired' end reason
 from history h left join safe using (vault_id)""",
    "hashed_refs": """select reason, vault_id, unnest([blob_ref, 'c'||k, 'c'||((k*7)%100)]) ref
 from retained where not tombstone""",
    "pins": """select distinct vault_id, ref from (select vault_id, ref from regrefs
 union all select vault_id, blob_ref from sync_base join (select distinct vault_id, file_id from w)
 using (file_id))""",
    "gone_refs": """select distinct vault_id, ref from hashed_refs r where reason='expired'
 and not exists (select 1 from pins p where p.vault_id=r.vault_id and p.ref=r.ref)
 and not exists (select 1 from hashed_refs k where k.reason<>'expired'
 and k.vault_id=r.vault_id and k.ref=r.ref)""",
    "active_plan": """select user_id, max_by(plan_id, (ends, sub_id)) plan_id, max(ends) ends
 from subs where status<>'F' and ends > timestamp '2001-01-01' group by 1""",
    "caps": """select u.user_id, coalesce(a.plan_id,'none') plan_id, coalesce(managed,false) managed,
 coalesce(external,false) external,
 cast(case when p.plan_id is null then 0 else max_vaults end as bigint) max_vaults,
 cast(case when p.plan_id is null then 0 else max_file end as bigint) max_file,
 cast(case when p.plan_id is null then 0 else quota end as bigint) quota
 from users u left join active_plan a using (user_id) left join plans p on p.plan_id=a.plan_id""",
    "past": "select lower(typed_code) code_key, user_id from checkouts where plan_id='5-LOW'",
    "previewed": """select c.*, d.*, case when d.code is null then 'not_found'
 when not is_active then 'code_inactive' when at_ts < starts_at then 'code_not_started'
 when at_ts >= expires_at then 'code_expired'
 when coalesce(used,0) >= max_redemptions then 'code_exhausted'
 when c.plan_id <> only_plan then 'wrong_plan' when c.user_id <> only_user then 'wrong_user'
 when original_kopecks < min_order then 'order_too_small'
 when coalesce(mine,0) >= max_per_user then 'user_limit_reached' else '' end reason
 from checkouts c left join codes d on lower(d.code)=lower(c.typed_code)
 left join (select code_key, count(*) used from past group by 1) p on p.code_key=lower(c.typed_code)
 left join (select code_key, user_id, count(*) mine from past group by 1,2) q
 on q.code_key=lower(c.typed_code) and q.user_id=c.user_id""",
    "discounted": """select *, cast(case when reason<>'' then 0
 when percent is not null then least(original_kopecks*percent//100, max_discount, original_kopecks)
 else least(kopecks, original_kopecks) end as bigint) discount_kopecks from previewed""",
    "url_tree": """select page_id file_id, i, ch[i] val from (select page_id, ch,
 unnest(range(1, len(ch)+1)) i from (select page_id, string_split(url,'') ch from pages))""",
    "nested": """select event_id doc, props, '{ "z": '||event_id||', "a": {"c": '||props||
 ', "b": [2, 1]}}' json from events""",
})
