"""Users, plans, subscriptions and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import Running, cut, first_per_key, running
from ..plans.skew import attach, attach_small


def owns_vault(requests: DataFrame, vaults: DataFrame) -> DataFrame:
    """J9. Each request with whether the user owns the vault."""
    owned = vaults.select("vault_id", "user_id").distinct().withColumn("_o", F.lit(True))
    return attach(requests, owned, ["vault_id", "user_id"]).withColumn(
        "owned", F.coalesce("_o", F.lit(False))).drop("_o")


def active_subs(subs: DataFrame, now: Column) -> DataFrame:
    """Latest-ending running subscription per user."""
    running_now = (F.col("status") != "F") & (F.col("ends") > now)
    return subs.where(running_now).groupBy("user_id").agg(
        F.max(F.struct("ends", "sub_id", "plan_id")).alias("a")).select(
        "user_id", "a.plan_id", "a.ends")


def list_users(users: DataFrame, subs: DataFrame, now: Column, q: str | None = None,
               limit: int = 50, offset: int = 0) -> DataFrame:
    """P1. One page of users by case-free e-mail substring, with active plan."""
    page = matching_users(users, q).orderBy("email", "user_id").offset(offset).limit(limit)
    return page.join(active_subs(subs, now), "user_id", "left")


def matching_users(users: DataFrame, q: str | None) -> DataFrame:
    if not q:
        return users
    return users.where(F.contains(F.lower("email"), F.lit(q.lower())))


def user_total(users: DataFrame, q: str | None = None) -> DataFrame:
    """P1. Size of the whole result the page is cut from."""
    return matching_users(users, q).agg(F.count(F.lit(1)).alias("total"))


def user_detail(users: DataFrame, subs: DataFrame, vaults: DataFrame) -> DataFrame:
    """P2. Per user: subscription count, newest subscription, vault count."""
    s = subs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_subs"), F.max(F.struct("started", "sub_id")).alias("_l"))
    v = vaults.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_vaults"))
    return users.join(s, "user_id", "left").join(v, "user_id", "left").select(
        "user_id", "email", "role", F.coalesce("n_subs", F.lit(0)).alias("n_subs"),
        F.coalesce("_l.sub_id", F.lit(-1)).alias("last_sub"),
        F.coalesce("n_vaults", F.lit(0)).alias("n_vaults"))


def subscription_status(users: DataFrame, subs: DataFrame, now: Column) -> DataFrame:
    """P3. active, expired or none, with period end and plan."""
    last = subs.where("status <> 'F'").groupBy("user_id").agg(
        F.max(F.struct("ends", "sub_id", "plan_id")).alias("l"))
    status = (F.when(F.col("l").isNull(), "none").when(F.col("l.ends") > now, "active")
              .otherwise("expired"))
    return users.select("user_id").join(last, "user_id", "left").select(
        "user_id", status.alias("status"), F.coalesce("l.plan_id", F.lit("")).alias("plan"),
        F.coalesce(F.unix_seconds("l.ends"), F.lit(0)).alias("period_end"))


def effective_caps(users: DataFrame, subs: DataFrame, plans: DataFrame, now: Column) -> DataFrame:
    """P4. Capabilities of the active plan; without one everything is denied (caps 0)."""
    plan = plans.select("plan_id", "managed", "external", "max_vaults", "max_file", "quota",
                        F.lit(True).alias("_p"))
    j = users.select("user_id").join(active_subs(subs, now), "user_id", "left").join(
        plan, "plan_id", "left")
    cap = lambda c: F.when(F.col("_p").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c)
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return j.select("user_id", F.coalesce("plan_id", F.lit("none")).alias("plan_id"),
                    flag("managed"), flag("external"), cap("max_vaults"), cap("max_file"),
                    cap("quota"))


def quota_usage(refs: DataFrame, sizes: DataFrame, owners: DataFrame, caps: DataFrame) -> DataFrame:
    """P5. Bytes over distinct blobs per vault, summed per owner, against the quota."""
    blobs = refs.select("vault_id", "ref").distinct()
    sized = attach(blobs, sizes, ["ref"])
    per_vault = sized.groupBy("vault_id").agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    used = owners.join(per_vault, "vault_id", "left").groupBy("user_id").agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("used_bytes"),
        F.count(F.lit(1)).alias("vaults"))
    return used.join(caps, "user_id", "left")


def enforce_caps(uploads: DataFrame, usage: DataFrame, caps: DataFrame) -> DataFrame:
    """P6. Uploads ``(user_id, seq, size, storage)`` with the code of the first cap they
    break, or ''. Null caps are unlimited and 0 denies. Storage counts what was used before
    plus every managed upload up to and including this one.
    """
    j = attach(uploads, caps, ["user_id"])
    j = attach(j, usage.select("user_id", "used_bytes"), ["user_id"])
    managed = F.col("storage") == "managed"
    led = running(j, ["user_id"], ["seq"], cut(uploads, "seq"),
                  [Running("_sum", "sum", F.when(managed, F.col("size")).otherwise(0))])
    total = F.coalesce("used_bytes", F.lit(0)) + F.col("_sum")
    code = (F.when(managed & ~F.col("managed"), "app_policy.feature.managed_storage_unavailable")
            .when(~managed & ~F.col("external"), "app_policy.feature.external_storage_unavailable")
            .when(managed & (F.col("size") > F.col("max_file")), "app_policy.quota.file_size")
            .when(managed & (total > F.col("quota")), "app_policy.quota.storage").otherwise(""))
    return led.select(*uploads.columns, code.alias("code"))


def vault_count_violations(vaults: DataFrame, caps: DataFrame) -> DataFrame:
    """P6. Users with more vaults than their plan allows."""
    n = vaults.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_vaults"))
    return n.join(caps, "user_id").where("n_vaults > max_vaults").select(
        "user_id", "n_vaults", "max_vaults", F.lit("app_policy.quota.vault_count").alias("code"))


def apply_grants(subs: DataFrame, grants: DataFrame, plans: DataFrame) -> DataFrame:
    """P7. Subscriptions after grants ``(sub_id, user_id, plan_id, at, days, reason)``."""
    p = plans.select("plan_id", "period_days", F.lit(0).cast("long").alias("amount_kopecks"))
    g = attach_small(grants, p, ["plan_id"])
    days = F.coalesce("days", "period_days").cast("int")
    granted = g.select(
        "sub_id", "user_id", "plan_id", F.lit("G").alias("status"), F.col("at").alias("started"),
        (F.col("at") + F.make_dt_interval(days)).alias("ends"), "amount_kopecks", "reason")
    return subs.withColumn("reason", F.lit("")).unionByName(granted)


def apply_revocations(subs: DataFrame, ids: DataFrame) -> DataFrame:
    """P8. Subscriptions with a revoked flag."""
    gone = ids.select("sub_id").distinct().withColumn("_r", F.lit(True))
    return subs.join(gone, "sub_id", "left").withColumn(
        "revoked", F.coalesce("_r", F.lit(False))).drop("_r")


def role_changes(users: DataFrame, changes: DataFrame) -> DataFrame:
    """P9. Each change ``(user_id, seq, new_role)`` with the role it replaces."""
    led = running(changes, ["user_id"], ["seq"], cut(changes, "seq"),
                  [Running("_p", "max", F.struct("seq", "new_role"), before=True)])
    j = attach(led, users.select("user_id", "role"), ["user_id"])
    return j.select("user_id", "seq", "new_role",
                    F.coalesce("_p.new_role", "role").alias("previous_role"))


def products(plans: DataFrame) -> DataFrame:
    """P10. Public catalogue: paid plans only."""
    return plans.where("acquisition = 'paid'").select("plan_id", "amount_kopecks", "period_days")


def invoices(subs: DataFrame, user_id: int) -> DataFrame:
    """P11. Invoices of one user; the filter reaches the scan."""
    return subs.where(F.col("user_id") == user_id).select(
        "sub_id", "plan_id", "status", "amount_kopecks")


def invoice_totals(subs: DataFrame) -> DataFrame:
    """P11. Count and amount per status."""
    return subs.groupBy("status").agg(F.count(F.lit(1)).alias("invoices"),
                                      F.sum("amount_kopecks").alias("amount_kopecks"))


def restore_subscriptions(pending: DataFrame, payments: DataFrame, subs: DataFrame) -> DataFrame:
    """P12. Pending orders whose payment succeeded but that never became a subscription."""
    paid = payments.where("succeeded").select("order_id").distinct()
    return (pending.join(paid, "order_id", "left_semi")
            .join(subs.select(F.col("sub_id").alias("order_id")), "order_id", "left_anti"))


def trial_grants(signups: DataFrame, granted: DataFrame) -> DataFrame:
    """P13. First sign-up per user without a trial so far."""
    return first_per_key(signups, ["user_id"], ["ts", "event_id"]).join(
        granted.select("user_id").distinct(), "user_id", "left_anti")


def promo_eligible(users: DataFrame, plans: DataFrame, allowed: DataFrame,
                   attempts: DataFrame) -> DataFrame:
    """P14. Attempts ``(attempt_id, user_id, plan_id, code)`` that match the plan's
    ``required_code`` or whose user's e-mail is allowed: ``allowed`` holds one row
    ``(plan_id, email)`` per listed address, however long a list is."""
    j = attach(attempts, users.select("user_id", "email"), ["user_id"])
    j = attach_small(j, plans.select("plan_id", "required_code"), ["plan_id"])
    listed = allowed.select("plan_id", "email").distinct().withColumn("_listed", F.lit(True))
    j = j.join(listed, ["plan_id", "email"], "left")
    by_code = F.coalesce(F.lower("code") == F.lower("required_code"), F.lit(False))
    return j.select("attempt_id", "user_id", "plan_id",
                    (by_code | F.coalesce("_listed", F.lit(False))).alias("eligible"))
