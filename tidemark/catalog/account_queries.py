"""Accounts, codes, reports and streams (J9, P*, W*, E*, U2)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixtures import VAULT_KEYS, Inputs, to_biz, to_blob_chunks, to_file_events
from ..functions import rejections
from ..operators import accounts, codes, ops
from ..session import settle
from ..sources.sinks import scratch_folder
from ..streaming import events as ev
from ..streaming import registers as reg
from .causal_queries import REJECTED
from .registry import query

NOW = "2001-01-01"


def now():
    return F.lit(NOW).cast("timestamp")


def orders(i: Inputs):
    return i.table("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


def caps(i: Inputs):
    return accounts.effective_caps(i.users(), i.subs(), i.plans(), now())


@query("j9_owns_vault", """select o_orderkey vault_id, case when o_orderkey%3=0 then o_custkey+1 else o_custkey end user_id,
 o_orderkey%3<>0 owned from orders""")
def j9(i: Inputs):
    o = i.table("orders")
    ask = o.select(F.col("o_orderkey").alias("vault_id"), F.when(
        F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("user_id"))
    return accounts.owns_vault(ask, o.select(F.col("o_orderkey").alias("vault_id"),
                                             F.col("o_custkey").alias("user_id")))


@query("p1_list_users", """select u.user_id, email, coalesce(plan_id,'') plan_id from (select * from users
 where email like '%00%' order by email, user_id limit 50 offset 100) u left join active_plan using (user_id)""")
def p1(i: Inputs):
    page = accounts.list_users(i.users(), i.subs(), now(), q="00", limit=50, offset=100)
    return page.select("user_id", "email", F.coalesce("plan_id", F.lit("")).alias("plan_id"))


@query("p1_user_total", "select count(*) total from users where email like '%00%'")
def p1_total(i: Inputs):
    return accounts.user_total(i.users(), "00")


@query("p2_user_detail", """select u.user_id, email, role, coalesce(n_subs,0) n_subs, coalesce(last_sub,-1) last_sub,
 coalesce(n_vaults,0) n_vaults from users u left join (select user_id, count(*) n_subs,
 max_by(sub_id,(started,sub_id)) last_sub from subs group by 1) using (user_id) left join
 (select o_custkey user_id, count(*) n_vaults from orders where o_orderstatus='O' group by 1) using (user_id)""")
def p2(i: Inputs):
    vaults = i.table("orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("user_id"))
    return accounts.user_detail(i.users(), i.subs(), vaults)


@query("p3_subscription_status", """with l as (select user_id, max_by(plan_id,(ends,sub_id)) plan, max(ends) ends from subs
 where status<>'F' group by 1) select u.user_id, case when ends is null then 'none' when ends > timestamp '2001-01-01'
 then 'active' else 'expired' end status, coalesce(l.plan,'') plan, coalesce(cast(epoch(ends) as bigint),0) period_end
 from users u left join l using (user_id)""")
def p3(i: Inputs):
    return accounts.subscription_status(i.users(), i.subs(), now())


@query("p4_effective_caps", """select user_id, plan_id, managed, external, coalesce(max_vaults,-1) max_vaults,
 coalesce(max_file,-1) max_file, coalesce(quota,-1) quota from caps""")
def p4(i: Inputs):
    return caps(i).fillna(-1, ["max_vaults", "max_file", "quota"])


@query("p5_quota_usage", """with o as (select distinct vault_id, cast(substr(vault_id,2) as bigint)+1 user_id from w),
 b as (select vault_id, sum(len) bytes from (select distinct vault_id, ref, length(ref)*10 len from refs) group by 1),
 u as (select user_id, cast(coalesce(sum(bytes),0) as bigint) used_bytes, count(*) vaults from o left join b using (vault_id)
 group by 1) select user_id, used_bytes, vaults, plan_id, coalesce(quota,-1) quota from u left join caps using (user_id)""")
def p5(i: Inputs):
    refs = i.refs()
    sizes = refs.select("ref").distinct().withColumn("size", (F.length("ref") * 10).cast("long"))
    owners = i.w().select("vault_id").distinct().withColumn(
        "user_id", F.substring("vault_id", 2, 9).cast("long") + 1)
    return accounts.quota_usage(refs, sizes, owners, caps(i)).select(
        "user_id", "used_bytes", "vaults", "plan_id", F.coalesce("quota", F.lit(-1)).alias("quota"))


def uploads(i: Inputs):
    return i.table("orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("size"),
        F.when(F.col("o_orderkey") % 4 == 0, "external").otherwise("managed").alias("storage"))


@query("p6_enforce_caps", """with u as (select o_custkey user_id, o_orderkey seq, cast(round(o_totalprice*100) as bigint) size,
 o_orderkey%4<>0 m from orders), x as (select u.*, managed, external, max_file, quota, user_id*1000 +
 sum(case when m then size else 0 end) over (partition by user_id order by seq) total from u join caps using (user_id))
 select user_id, seq, case when m and not managed then 'app_policy.feature.managed_storage_unavailable'
 when not m and not external then 'app_policy.feature.external_storage_unavailable'
 when m and size>max_file then 'app_policy.quota.file_size' when m and total>quota then 'app_policy.quota.storage'
 else '' end code from x""")
def p6(i: Inputs):
    usage = i.users().select("user_id", (F.col("user_id") * 1000).alias("used_bytes"))
    return accounts.enforce_caps(uploads(i), usage, settle(caps(i))).select("user_id", "seq", "code")


@query("p6_vault_count", """select user_id, count(*) n_vaults, max(max_vaults) max_vaults,
 'app_policy.quota.vault_count' code from orders o join caps on caps.user_id=o.o_custkey
 group by 1 having count(*)>max(max_vaults)""")
def p6_vaults(i: Inputs):
    v = i.table("orders").select(F.col("o_custkey").alias("user_id"))
    return accounts.vault_count_violations(v, caps(i))


@query("p7_apply_grants", """select sub_id, user_id, plan_id, cast(epoch(ends) as bigint) ends, '' reason from subs union all
 select 10000000+user_id, user_id, plan_id, cast(epoch(timestamp '2000-12-01') as bigint)+86400*coalesce(n_days,period_days), 'support'
 from (select user_id, case when user_id%2=0 then '5-LOW' else '2-HIGH' end plan_id,
 case when user_id%3=0 then 7 end n_days from users) join plans using (plan_id)""")
def p7(i: Inputs):
    u = F.col("user_id")
    grants = i.users().select(
        (u + 10_000_000).alias("sub_id"), u, F.when(u % 2 == 0, "5-LOW").otherwise("2-HIGH").alias("plan_id"),
        F.lit("2000-12-01").cast("timestamp").alias("at"), F.when(u % 3 == 0, 7).alias("days"),
        F.lit("support").alias("reason"))
    return accounts.apply_grants(i.subs(), grants, i.plans()).select(
        "sub_id", "user_id", "plan_id", F.unix_seconds("ends").alias("ends"), "reason")


@query("p8_apply_revocations", """select sub_id, status='P' revoked from subs""")
def p8(i: Inputs):
    ids = i.subs().where("status = 'P'").select("sub_id")
    return accounts.apply_revocations(i.subs(), ids).select("sub_id", "revoked")


@query("p9_role_changes", """with x as (select user_id, event_id seq, case when value>=50 then 'admin' else 'user' end new_role
 from events) select x.user_id, seq, new_role, coalesce(lag(new_role) over (partition by x.user_id order by seq), role, '')
 previous_role from x left join users using (user_id)""")
def p9(i: Inputs):
    changes = i.table("events").select("user_id", F.col("event_id").alias("seq"), F.when(
        F.col("value") >= 50, "admin").otherwise("user").alias("new_role"))
    return accounts.role_changes(i.users(), changes).fillna("", ["previous_role"])


@query("p10_products", "select plan_id, amount_kopecks, period_days from plans where acquisition='paid'")
def p10(i: Inputs):
    bought = i.subs().select("plan_id").distinct()
    return accounts.products(i.plans()).join(bought, "plan_id", "left_semi")


@query("p11_invoices", "select sub_id, plan_id, status, amount_kopecks from subs where user_id=7")
def p11(i: Inputs):
    return accounts.invoices(i.subs(), 7)


@query("p11_invoice_totals", """select status, count(*) invoices, cast(sum(amount_kopecks) as bigint) amount_kopecks
 from subs group by 1""")
def p11_totals(i: Inputs):
    return accounts.invoice_totals(i.subs())


@query("p12_restore_subscriptions", """select o_orderkey order_id, o_custkey user_id from orders where o_orderstatus<>'O'
 and o_orderkey in (select l_orderkey from lineitem where l_returnflag='N')
 and o_orderkey not in (select sub_id from subs where plan_id='1-URGENT')""")
def p12(i: Inputs):
    pending = i.table("orders").where("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"))
    pay = i.table("lineitem").select(F.col("l_orderkey").alias("order_id"),
                                     (F.col("l_returnflag") == "N").alias("succeeded"))
    return accounts.restore_subscriptions(pending, pay, i.subs().where("plan_id = '1-URGENT'"))


@query("p13_trial_grants", """select user_id, min_by(event_id,(ts,event_id)) event_id from events where event_type='signup'
 and user_id not in (select user_id from events where event_type='purchase' and value>=45) group by 1""")
def p13(i: Inputs):
    e = i.table("events")
    return accounts.trial_grants(
        e.where("event_type = 'signup'"), e.where("event_type = 'purchase' and value >= 45").select("user_id")
    ).select("user_id", "event_id")


@query("p14_promo_eligible", """select o_orderkey attempt_id, o_custkey user_id, o_orderpriority plan_id,
 (o_orderpriority='5-LOW' and o_orderkey%3=0) or (o_orderpriority='2-HIGH' and email like '%7@example.com') eligible
 from orders join users on user_id=o_custkey""")
def p14(i: Inputs):
    listed = i.users().where("email like '%7@example.com'").select(
        F.lit("2-HIGH").alias("plan_id"), "email")
    plans = i.plans().select("plan_id", F.when(F.col("plan_id") == "5-LOW", "PROMO").alias("required_code"))
    tries = i.table("orders").select(
        F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("plan_id"), F.when(F.col("o_orderkey") % 3 == 0, "promo").otherwise(
            "").alias("code"))
    return accounts.promo_eligible(i.users(), plans, listed, tries)


@query("p15_promo_redeemable", """select code, is_active and (expires_at is null or timestamp '2001-01-01'<expires_at)
 and (max_redemptions is null or coalesce(n,0)<max_redemptions) redeemable from codes left join
 (select code_key, count(*) n from past group by 1) on code_key=lower(code)""")
def p15(i: Inputs):
    done = past(i).groupBy("code_key").agg(F.count(F.lit(1)).alias("redeemed"))
    c = i.codes().withColumn("code_key", F.lower("code")).join(done, "code_key", "left").fillna(
        0, ["redeemed"])
    return codes.promo_redeemable(c, now()).select("code", "redeemable")


def past(i: Inputs):
    return i.checkouts().where("plan_id = '5-LOW'").select(
        F.lower("typed_code").alias("code_key"), "user_id")


@query("p16_redeem_promos", """with f as (select *, lower(typed_code) code_key from checkouts qualify row_number() over
 (partition by lower(typed_code), user_id order by seq)=1), g as (select f.*, d.code, d.campaign, max_redemptions from f
 join codes d on lower(d.code)=f.code_key where is_active and (expires_at is null or at_ts<expires_at)
 and not exists (select 1 from past p where p.code_key=f.code_key and p.user_id=f.user_id)),
 n as (select *, row_number() over (partition by code_key order by seq) i from g)
 select seq, code, user_id, campaign from n left join (select code_key, count(*) used from past group by 1) using (code_key)
 where max_redemptions is null or i+coalesce(used,0)<=max_redemptions""")
def p16(i: Inputs):
    return codes.redeem_promos(i.checkouts(), i.codes(), past(i))


def previewed(i: Inputs):
    return codes.preview_discounts(i.checkouts(), i.codes(), past(i))


@query("p17_preview_discounts", "select seq, order_id, reason from previewed")
def p17(i: Inputs):
    return previewed(i).select("seq", "order_id", "reason")


@query("p18_apply_discount", """select seq, discount_kopecks, greatest(original_kopecks-discount_kopecks,0) final_kopecks
 from discounted""")
def p18(i: Inputs):
    return codes.apply_discount(previewed(i)).select("seq", "discount_kopecks", "final_kopecks")


@query("p19_record_redemptions", "select code, count(*) redemption_count from discounted where reason='' group by 1")
def p19(i: Inputs):
    return codes.record_redemptions(codes.apply_discount(previewed(i)))[1]


@query("p19_audit_rows", """select seq, order_id, code, user_id, campaign, original_kopecks, discount_kopecks,
 greatest(original_kopecks-discount_kopecks,0) final_kopecks from discounted where reason=''""")
def p19_audit(i: Inputs):
    return codes.record_redemptions(codes.apply_discount(previewed(i)))[0]


@query("p20_list_codes", "select code, campaign, is_active from codes where is_active")
def p20(i: Inputs):
    return codes.list_codes(i.codes(), active=True).select("code", "campaign", "is_active")


@query("p21_campaign_report", """select c.campaign, codes, coalesce(redemptions,0) redemptions, coalesce(discount,0) discount,
 coalesce(revenue,0) revenue from (select campaign, count(*) codes from codes group by 1) c left join
 (select campaign, count(*) redemptions, cast(sum(discount_kopecks) as bigint) discount,
 cast(sum(greatest(original_kopecks-discount_kopecks,0)) as bigint) revenue from discounted where reason='' group by 1) r
 on r.campaign=c.campaign""")
def p21(i: Inputs):
    audit = codes.record_redemptions(codes.apply_discount(previewed(i)))[0]
    return codes.campaign_report(i.codes(), audit)


@query("p22_code_batch", """select count(*) n, count(*) distinct_codes, true well_formed from customer""")
def p22(i: Inputs):
    n = i.table("customer").count()
    batch = codes.code_batch(i.spark, n, "SPRING", "2026")
    return batch.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("distinct_codes"),
                     F.min(F.col("code").rlike("^SPRING-[0-9A-F]{10}-[0-9A-F]+$")).alias("well_formed"))


# W -------------------------------------------------------------------------------------
@query("w1_latest_logs", "select event_id, event_type from events order by ts desc, event_id desc limit 1000")
def w1(i: Inputs):
    return ops.latest_logs(i.table("events"), 1000).select("event_id", "event_type")


@query("w2_pull_report", """with t as (select vault_id, file_id, size_bytes//10 took_ms from w)
 select vault_id, count(*) files, count(*) filter (took_ms>200) slow, max({'a':took_ms,'b':file_id}).b slowest_file,
 max(took_ms) slowest_ms, cast(sum(took_ms) as bigint) total_ms from t group by 1""")
def w2(i: Inputs):
    return ops.pull_report(i.w().select(*VAULT_KEYS, F.expr("size_bytes div 10").alias("took_ms")))


def engine_events(frame):
    t = F.col("event_type")
    kind = (F.when(t == "view", "pulling").when(t == "click", "pushing").when(t == "signup", "connected")
            .when(t == "purchase", "note").otherwise("error"))
    return frame.select(F.concat(F.lit("u"), "user_id").alias("device"), "ts", "event_id", kind.alias("kind"))


@query("w3_device_status", """select 'u'||user_id device, max_by(case event_type when 'view' then 'pulling' when 'click' then 'pushing'
 when 'signup' then 'idle' else 'error' end, (ts,event_id)) status from events where event_type<>'purchase' group by 1""")
def w3(i: Inputs):
    return ops.device_status(engine_events(i.table("events")))


STATUS_AT = """with e as (select event_id, user_id u, epoch_us(ts)//1000 ms, event_type t, event_id%6 k from events),
 x as (select *, case when t='purchase' then null when k=0 then 'file_pulled' when k=1 then 'file_pushed'
 when k=2 then 'blob_upload_done' when k=3 then 'server_rejected' when k=4 then 'error' else 'pending' end kind,
 case when event_id%4=0 then 'app_policy.x' when event_id%4=1 then 'rpc.x' end code from e),
 y as (select *, case kind when 'file_pulled' then 'pulling' when 'file_pushed' then 'pushing' when 'blob_upload_done'
 then 'idle' when 'error' then 'error' when 'server_rejected' then case when code='app_policy.x' then 'sub_expired' end
 end s, case kind when 'file_pulled' then ms+7200000 when 'file_pushed' then ms+7200000 when 'error' then ms+36000000 end d
 from x),
 z as (select *, max(case when s is not null then {'ms':ms,'e':event_id,'s':s} end) over w ls,
 max(case when s is not null and kind<>'blob_upload_done' then {'ms':ms,'e':event_id,'d':d} end) over w lt,
 max(case when kind='pending' then {'ms':ms,'e':event_id,'p':event_id%5<2} end) over w lf from y
 window w as (partition by u order by ms, t='purchase', event_id))
 select event_id probe_id, 'u'||u device, case when lt.d<=ms and ls.ms<=lt.d then 'idle' else coalesce(ls.s,'off') end status,
 coalesce(lf.p,false) pending from z where t='purchase'"""


@query("w3_status_at", STATUS_AT)
def w3_at(i: Inputs):
    """Every purchase asks what the device shows; the other events are engine events."""
    e = i.table("events").select("event_id", F.concat(F.lit("u"), "user_id").alias("device"), "event_type",
                                 F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    kinds = ["file_pulled", "file_pushed", "blob_upload_done", "server_rejected", "error", "pending"]
    told = e.where("event_type <> 'purchase'").select(
        "device", "ms", "event_id", F.element_at(F.array(*[F.lit(x) for x in kinds]),
                                                 (F.col("event_id") % 6 + 1).cast("int")).alias("kind"),
        F.when(F.col("event_id") % 4 == 0, "app_policy.x").when(F.col("event_id") % 4 == 1, "rpc.x").alias("code"),
        (F.col("event_id") % 5 < 2).alias("pending"))
    asked = e.where("event_type = 'purchase'").select(F.col("event_id").alias("probe_id"), "device", "ms")
    return ops.status_at(told, asked, {"file_pulled": 7_200_000, "file_pushed": 7_200_000, "error": 36_000_000})


def marks(i: Inputs):
    k = F.col("kind")
    return i.file_events().withColumn("kind", F.when(k.isin("modified", "created"), "mark").when(
        k == "moved", "clear").otherwise("other"))


MARKED = """marked as (select device, path from file_events where kind in ('modified','created','moved') group by 1,2
 having max_by(kind,(ts,event_id)) in ('modified','created'))"""


@query("w4_pending_files", f"with {MARKED} select device, path from marked")
def w4(i: Inputs):
    return ops.pending_files(marks(i))


@query("w4_pending_flags", f"""with {MARKED} select device, count(marked.path) pending from
 (select distinct device from file_events) left join marked using (device) group by 1""")
def w4_flags(i: Inputs):
    return ops.pending_flags(marks(i))


@query("w5_coalesce_latest", """select 'n'||(user_id%40) task, max(event_id) event_id, max_by(event_type,event_id) grp
 from events group by 1""")
def w5(i: Inputs):
    tasks = i.table("events").select(F.concat(F.lit("n"), F.col("user_id") % 40).alias("task"), "event_id",
                                     F.col("event_type").alias("grp"))
    return ops.coalesce_latest(tasks, "task", "event_id")


@query("u2_typed_rejections", f"""select event_id, case code when 'auth.session_expired' then 'SessionExpired'
 when 'app_policy.subscription_required' then 'SubscriptionRequired' when 'auth.permission_denied' then 'Denied'
 when '' then '' else 'ServerRejected' end typed from ({REJECTED})""")
def u2(i: Inputs):
    table = {"auth.session_expired": "SessionExpired", "auth.permission_denied": "Denied",
             "app_policy.subscription_required": "SubscriptionRequired"}
    parsed = rejections.parse_rejections(i.rejections())
    return rejections.typed_rejections(parsed, table).select(
        "event_id", F.coalesce("typed", F.lit("")).alias("typed"))


# E -------------------------------------------------------------------------------------
TWO_HOURS = 7_200_000_000


def stream_table(i: Inputs, name: str):
    schema = i.table(name).schema
    return i.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(i.folder)


def event_stream(i: Inputs):
    return stream_table(i, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(i: Inputs, stream, name: str):
    """Run a stream over what its source holds and read back what it wrote."""
    out = scratch_folder(i.spark, name)
    (stream.writeStream.format("parquet").option("path", f"{out}/rows")
     .option("checkpointLocation", f"{out}/progress").outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())
    return i.spark.read.schema(T.StructType(stream.schema.fields)).parquet(f"{out}/rows")


SESSIONS = f"""s as (select device, path, kind, epoch_us(ts) us, event_id, epoch_us(ts) - lag(epoch_us(ts)) over
 (partition by device, path order by ts, event_id) gap from file_events), t as (select *, sum(case when gap is null or
 gap>{TWO_HOURS} then 1 else 0 end) over (partition by device, path order by us, event_id) sid from s),
 sessions as (select device, path, min(us) start_us, count(*) events, max(us)+{TWO_HOURS} fires_us
 from t group by device, path, sid having bool_or(kind<>'typing'))"""


@query("e1_debounce_batch", f"with {SESSIONS} select * from sessions")
def e1(i: Inputs):
    return ev.debounce_batch(i.file_events(), TWO_HOURS)


@query("e1_debounce_stream", f"""with {SESSIONS} select device, path, start_us, events, fires_us from sessions
 where fires_us <= (select max(epoch_us(ts))//1000*1000 - 10000000 from events)""")
def e1_stream(i: Inputs):
    out = drained(i, ev.debounce(to_file_events(event_stream(i)), "2 hours"), "debounce")
    return out.select("device", "path", F.unix_micros("start").alias("start_us"), "events",
                      F.unix_micros("fires_at").alias("fires_us"))


def echo_ops(frame):
    """Editor events as own-write marks (created) and disk events (the rest, but typing)."""
    f = to_file_events(frame).where("kind <> 'typing'")
    mark = F.col("kind") == "created"
    return f.select("device", "ts", F.col("event_id").alias("seq"), "event_id", "path", "old_path",
                    F.when(mark, "mark").otherwise("event").alias("kind"),
                    F.when(mark, 1 + F.col("event_id") % 2).otherwise(0).alias("n"))


ECHO = """with o as (select device, path, epoch_us(ts)//1000 ms, event_id, case when kind='created' then 1+event_id%2
 else -1 end d from file_events where kind<>'typing'), m as (select *, max(case when d>0 then ms end) over (
 partition by device, path order by ms, event_id rows between unbounded preceding and 1 preceding) lm from o),
 e as (select *, lm is not null and ms-lm<7200000 live from m), f as (select *, sum(case when d>0 and not live then 1
 else 0 end) over (partition by device, path order by ms, event_id) era, d>0 or live busy from e),
 s as (select *, sum(d) over (partition by device, path, era order by ms, event_id) s from f where busy),
 g as (select *, least(0, coalesce(min(s) over (partition by device, path, era order by ms, event_id
 rows between unbounded preceding and 1 preceding),0)) debt from s)
 select device, event_id, s-d-debt>0 suppressed from g where d<0
 union all select device, event_id, false from f where not busy"""


@query("e2_suppress_echo_batch", ECHO)
def e2(i: Inputs):
    return ev.suppress_echo_batch(echo_ops(i.events()), 7_200_000)


@query("e2_suppress_echo_stream", ECHO)
def e2_stream(i: Inputs):
    out = scratch_folder(i.spark, "echo")
    reg.run_available(echo_ops(event_stream(i)), ev.suppress_echo(out, 7_200_000), f"{out}/progress")
    return i.spark.read.parquet(f"{out}/rows").select("device", "event_id", "suppressed")


@query("e3_dedupe_chunks", "select blob_id, off from blob_chunks group by 1,2")
def e3(i: Inputs):
    return ev.dedupe_chunks(i.blob_chunks(), None).select("blob_id", "off")


@query("e3_dedupe_chunks_stream", "select blob_id, off from blob_chunks group by 1,2")
def e3_stream(i: Inputs):
    chunks = to_blob_chunks(stream_table(i, "lineitem"))
    return drained(i, ev.dedupe_chunks(chunks).select("blob_id", "off"), "chunks")


def announced(chunks):
    """Unit-length chunks whose blob announces a total; the chunk ending there is the last."""
    total = (F.col("blob_id") % 7 + 1).cast("long")
    off = (F.col("off") - 1).cast("long")
    return chunks.select("blob_id", off.alias("off"), F.lit(1).cast("long").alias("len"),
                         (off + 1 == total).alias("last"), total.alias("total"), "ts")


@query("e4_assemble_blobs", """with d as (select distinct blob_id, off-1 off, blob_id%7+1 total from blob_chunks)
 select blob_id, count(*) chunks, count(*) received, list(off order by off)=range(0, max(total)) complete
 from d group by 1""")
def e4(i: Inputs):
    return ev.assemble_blobs(ev.dedupe_chunks(announced(i.blob_chunks()), None))


@query("e4_blob_pieces_stream", """with d as (select distinct blob_id, off-1 off, blob_id%7+1 total from blob_chunks
 where off-1<blob_id%7+1), whole as (select blob_id from d group by 1 having count(*)=max(total))
 select blob_id, off piece_no, off, substr(md5(blob_id||':'||off), 1, 1) piece from d join whole using (blob_id)""")
def e4_pieces(i: Inputs):
    """Chunks come in four batches, out of order and with repeats; every batch runs twice."""
    name = F.concat_ws(":", F.col("blob_id").cast("string"), F.col("off").cast("string"))
    chunks = announced(i.blob_chunks()).where("off < total").withColumn(
        "bytes", F.substring(F.md5(name), 1, 1).cast("binary")).drop("len")
    src, out = scratch_folder(i.spark, "chunks"), scratch_folder(i.spark, "pieces")
    chunks.unionByName(chunks.where("off = 1")).repartition(4, "off", "blob_id").write.parquet(src)
    body = ev.stream_blobs(out, 1 << 50)

    def twice(rows, batch):
        body(rows, batch)
        body(rows, batch)

    stream = i.spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(src)
    reg.run_available(stream, twice, f"{out}/progress")
    return i.spark.read.parquet(f"{out}/pieces").select(
        "blob_id", "piece_no", "off", F.col("bytes").cast("string").alias("piece"))


@query("e4_adopt_ids", """with u as (select o_custkey upload_id, o_orderkey seq, case when o_orderstatus='O' then
 o_orderkey end b from orders) select upload_id, seq, coalesce(last_value(b ignore nulls) over (partition by upload_id
 order by seq), -1) blob_id from u""")
def e4_ids(i: Inputs):
    ups = i.table("orders").select(
        F.col("o_custkey").alias("upload_id"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey")).alias("blob_id"))
    ok, refused = ev.adopt_ids(ups)
    return ok.select("upload_id", "seq", "blob_id").unionByName(
        refused.select("upload_id", "seq", F.lit(-1).cast("long").alias("blob_id")))


def put_stream(i: Inputs, batches: int = 1):
    """The write log with context maps, as files a stream reads, one for each batch if there are several."""
    ctx = i.c().groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("node", "h"))).alias("context"))
    puts = i.w().join(ctx, "event_id", "left").withColumn("context", F.coalesce(
        "context", F.expr("cast(map() as map<string,struct<ms:bigint,cnt:bigint>>)")))
    src = scratch_folder(i.spark, "puts")
    if batches == 1:
        puts.write.parquet(src)
        return i.spark.readStream.schema(puts.schema).parquet(src)
    puts.repartition(batches, "event_id").write.parquet(src)
    return i.spark.readStream.schema(puts.schema).option("maxFilesPerTrigger", 1).parquet(src)


@query("e5_stream_registers", "select event_id, vault_id, file_id from surv")
def e5(i: Inputs):
    out = scratch_folder(i.spark, "stream-registers")
    body = reg.stream_registers(out, 8)

    def twice(puts, batch):
        """Every batch runs again, and the table is compacted between batches."""
        body(puts, batch)
        if batch == 1:
            reg.compact_registers(i.spark, out, 5)
        body(puts, batch)

    reg.run_available(put_stream(i, 4), twice, f"{out}/progress")
    return reg.read_stream_registers(i.spark, out).select("event_id", *VAULT_KEYS)


@query("e6_stream_history", "select event_id, op from history")
def e6(i: Inputs):
    out = scratch_folder(i.spark, "stream-history")
    reg.run_available(put_stream(i), reg.stream_history(f"{out}/rows"), f"{out}/progress")
    return i.spark.read.parquet(f"{out}/rows").select("event_id", "op")


@query("e7_vault_notifications", """select 'states-changed:'||vault_id topic, max(server_seq) cursor, count(*) items,
 max_by(node,server_seq) "source" from w group by vault_id""")
def e7(i: Inputs):
    out = scratch_folder(i.spark, "stream-notifications")
    reg.run_available(put_stream(i), reg.stream_notifications(f"{out}/rows"), f"{out}/progress")
    return i.spark.read.parquet(f"{out}/rows").select("topic", "cursor", "items", "source")


MOVES = """select event_id, device, path target, case when kind='moved' and old_path is null then 'created' when kind='moved'
 then 'changed' else kind end op from file_events union all select event_id, device, old_path, 'deleted'
 from file_events where kind='moved' and old_path is not null"""


@query("e8_expand_moves", MOVES)
def e8(i: Inputs):
    return ev.expand_moves(i.file_events()).select("event_id", "device", "target", "op")


@query("e8_expand_moves_stream", MOVES)
def e8_stream(i: Inputs):
    moves = ev.expand_moves(to_file_events(event_stream(i))).select("event_id", "device", "target", "op")
    return drained(i, moves, "moves")


def calls(frame):
    return frame.select(F.concat(F.lit("d"), F.col("user_id") % 3).alias("connection"), "event_id", "ts")


@query("e9_rate_violations", """select connection, event_id, calls from (select 'd'||(user_id%3) connection, event_id,
 count(*) over (partition by user_id%3 order by epoch_us(ts) range between 3599999999 preceding and current row) calls
 from events) where calls>8""")
def e9(i: Inputs):
    return ev.rate_violations_batch(calls(i.events()), 8, 3_600_000_000)


@query("e9_rate_violations_stream", """with x as (select 'd'||(user_id%3) connection, epoch_us(ts) us from events),
 y as (select connection, (us//900000000-k)*900000000 s from x, range(4) r(k)), z as (select connection, s, count(*) calls
 from y group by 1,2) select connection, s start_us, calls from z where calls>8 and
 s+3600000000 <= (select max(epoch_us(ts))//1000*1000-10000000 from events)""")
def e9_stream(i: Inputs):
    v = ev.rate_violations(calls(event_stream(i)), 8, "1 hour", "15 minutes")
    return drained(i, v, "rates").select("connection", F.unix_micros("start").alias("start_us"), "calls")


BIZ = """select (epoch_us(date_trunc('day', ts))//1000) start_ms, count(*) filter (name='user.registered') registrations,
 count(*) filter (name='user.signed_in') sign_ins, count(*) filter (name='vault.created') vaults,
 count(*) filter (name='sync.session_started') sessions, count(*) filter (name='payment.completed') payments,
 cast(coalesce(sum(amount_kopecks),0) as bigint) amount_kopecks from biz group by 1"""


@query("e10_business_counts", BIZ)
def e10(i: Inputs):
    return ev.business_counts(i.biz())


@query("e10_business_counts_stream", f"""select * from ({BIZ}) where start_ms+86400000 <=
 (select max(epoch_us(ts))//1000-3600000 from events)""")
def e10_stream(i: Inputs):
    return drained(i, ev.business_counts(to_biz(event_stream(i))), "business")


@query("e11_late_guard", "select event_id from events where (event_id%13)*60000 <= 300000")
def e11(i: Inputs):
    stream = event_stream(i).withColumn("ms", F.unix_millis("ts")).withColumn(
        "received_ms", F.col("ms") - (F.col("event_id") % 13) * 60000)
    ok, _ = ev.late_guard(stream.select("event_id", "ts", "ms", "received_ms"), "received_ms", ["event_id"])
    return drained(i, ok.select("event_id"), "late")
