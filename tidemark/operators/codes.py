"""Promo and discount codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import cut, first_per_key, number_rows
from ..plans.skew import attach, attach_small

# Reasons a discount is refused, in the order they are checked.
REASONS = ("not_found", "code_inactive", "code_not_started", "code_expired", "code_exhausted",
           "wrong_plan", "wrong_user", "order_too_small", "user_limit_reached")


def promo_redeemable(codes: DataFrame, now: Column) -> DataFrame:
    """P15. Active, not expired, under its cap (``redeemed`` counts redemptions so far)."""
    ok = (F.col("is_active")
          & (F.col("expires_at").isNull() | (now < F.col("expires_at")))
          & (F.col("max_redemptions").isNull() | (F.col("redeemed") < F.col("max_redemptions"))))
    return codes.withColumn("redeemable", ok)


def redeem_promos(attempts: DataFrame, codes: DataFrame, past: DataFrame,
                  width: int | None = None) -> DataFrame:
    """P16. Accepted redemptions in arrival order: one per (code, user), within each cap.

    ``attempts``: ``(seq, user_id, typed_code, at_ts)``; ``past``: ``(code_key, user_id)``; ``width``: of `cut`.
    """
    keyed = attempts.withColumn("code_key", F.lower("typed_code"))
    known = codes.withColumn("code_key", F.lower("code")).select(
        "code_key", "code", "is_active", "expires_at", "max_redemptions", "campaign")
    done = past.groupBy("code_key").agg(F.count(F.lit(1)).alias("redeemed"))
    once = first_per_key(keyed, ["code_key", "user_id"], ["seq"]).join(
        past.select("code_key", "user_id").distinct(), ["code_key", "user_id"], "left_anti")
    j = attach_small(once, known.join(done, "code_key", "left"), ["code_key"])
    open_now = F.col("is_active") & (
        F.col("expires_at").isNull() | (F.col("at_ts") < F.col("expires_at")))
    queued = number_rows(j.where(open_now), ["code_key"], ["seq"], cut(attempts, "seq", width), "_n")
    room = F.col("max_redemptions").isNull() | (
        F.col("_n") + F.coalesce("redeemed", F.lit(0)) <= F.col("max_redemptions"))
    return queued.where(room).select("seq", "code", "user_id", "campaign")


def preview_discounts(orders: DataFrame, codes: DataFrame, past: DataFrame) -> DataFrame:
    """P17. Orders with the first failing reason ('' when the code applies) and the code's
    terms. ``past``: ``(code_key, user_id)``, one row per earlier redemption."""
    keyed = orders.withColumn("code_key", F.lower("typed_code"))
    known = codes.withColumn("code_key", F.lower("code"))
    per_code = past.groupBy("code_key").agg(F.count(F.lit(1)).alias("_used"))
    per_user = past.groupBy("code_key", "user_id").agg(F.count(F.lit(1)).alias("_mine"))
    j = attach_small(keyed, known.join(per_code, "code_key", "left"), ["code_key"])
    j = attach(j, per_user, ["code_key", "user_id"])
    at = F.col("at_ts")
    checks = (F.col("code").isNull(), ~F.col("is_active"), at < F.col("starts_at"),
              at >= F.col("expires_at"),
              F.coalesce("_used", F.lit(0)) >= F.col("max_redemptions"),
              F.col("plan_id") != F.col("only_plan"), F.col("user_id") != F.col("only_user"),
              F.col("original_kopecks") < F.col("min_order"),
              F.coalesce("_mine", F.lit(0)) >= F.col("max_per_user"))
    reason = F.when(checks[0], REASONS[0])
    for check, name in zip(checks[1:], REASONS[1:]):
        reason = reason.when(check, name)
    return j.withColumn("reason", reason.otherwise("")).drop("_used", "_mine")


def apply_discount(previewed: DataFrame) -> DataFrame:
    """P18. Discount and final amount: percent rounds down and may be capped, a fixed amount
    is clamped to the order."""
    total = F.col("original_kopecks")
    percent = F.expr("original_kopecks * percent div 100")
    discount = F.when(F.col("percent").isNotNull(), F.least(percent, "max_discount")).otherwise(
        F.least(F.col("kopecks").cast("long"), total))
    applied = F.when(F.col("reason") == "", F.least(discount, total)).otherwise(0).cast("long")
    return previewed.withColumn("discount_kopecks", applied).withColumn(
        "final_kopecks", F.greatest(total - F.col("discount_kopecks"), F.lit(0)))


def record_redemptions(applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P19. (audit rows of paid orders, redemptions per code)."""
    audit = applied.where("reason = ''").select(
        "seq", "order_id", "code", "user_id", "campaign", "original_kopecks", "discount_kopecks",
        "final_kopecks")
    return audit, audit.groupBy("code").agg(F.count(F.lit(1)).alias("redemption_count"))


def list_codes(codes: DataFrame, campaign: str | None = None, active: bool | None = None,
               limit: int | None = None, after: str | None = None) -> DataFrame:
    """P20. The codes in order, or a page of ``limit`` of them that follow the code ``after``;
    deactivation is a flag, so inactive codes are listed too."""
    if campaign is not None:
        codes = codes.where(F.col("campaign") == campaign)
    if active is not None:
        codes = codes.where(F.col("is_active") == active)
    if after is not None:
        codes = codes.where(F.col("code") > after)
    codes = codes.orderBy("code")
    return codes if limit is None else codes.limit(limit)


def campaign_report(codes: DataFrame, audit: DataFrame) -> DataFrame:
    """P21. Codes, redemptions, discount and revenue per campaign."""
    n = codes.groupBy("campaign").agg(F.count(F.lit(1)).alias("codes"))
    r = audit.groupBy("campaign").agg(
        F.count(F.lit(1)).alias("redemptions"), F.sum("discount_kopecks").alias("discount"),
        F.sum("final_kopecks").alias("revenue"))
    return n.join(r, "campaign", "left").fillna(0, ["redemptions", "discount", "revenue"])


def code_batch(spark: SparkSession, n: int, prefix: str, seed: str, length: int = 10) -> DataFrame:
    """P22. ``n`` distinct codes: a hash suffix for looks, the counter for uniqueness."""
    i = F.col("id")
    suffix = F.upper(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), i.cast("string")), 256),
                                 1, length))
    return spark.range(n).select(
        F.concat(F.lit(prefix + "-"), suffix, F.lit("-"), F.upper(F.hex(i))).alias("code"),
        F.lit(True).alias("is_active"), F.lit(0).cast("long").alias("redemption_count"))
