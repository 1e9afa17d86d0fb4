"""Server error texts to structured rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICY = r"(app_policy\.[a-z0-9_.]+)(?::(.*))?"


def parse_rejections(log: DataFrame, message: str = "msg") -> DataFrame:
    """Add ``code``, ``params`` (map) and ``fatal``; code is null for other errors."""
    msg = F.col(message)
    low = F.lower(msg)
    code = (F.when(low.contains("unauthenticated"), F.lit("auth.session_expired"))
            .when(low.contains("payment_required"), F.lit("app_policy.subscription_required"))
            .when(low.contains("permission_denied"), F.lit("auth.permission_denied"))
            .when(msg.rlike(POLICY), F.regexp_extract(msg, POLICY, 1)))
    words = (low.contains("unauthenticated") | low.contains("payment_required")
             | low.contains("permission_denied"))
    raw = F.when(~words, F.regexp_extract(msg, POLICY, 2)).otherwise(F.lit(""))
    every = F.filter(F.split(raw, ","), lambda p: F.instr(p, "=") > 1)
    last_wins = lambda p, i: ~F.exists(F.slice(every, i + 2, F.size(every)),
                                       lambda q: _key(q) == _key(p))
    pairs = F.filter(every, last_wins)
    params = F.map_from_entries(F.transform(
        pairs, lambda p: F.struct(_key(p).alias("key"),
                                  F.substr(p, F.instr(p, "=") + 1).alias("value"))))
    return (log.withColumn("code", code).withColumn("params", params)
            .withColumn("fatal", F.coalesce(is_fatal(F.col("code")), F.lit(False))))


def _key(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def is_fatal(code: Column) -> Column:
    return code.startswith("auth.") | code.startswith("app_policy.")


# Rejection code to the typed event an application shows for it.
TYPED = {
    "auth.session_expired": "SessionExpired",
    "auth.permission_denied": "PermissionDenied",
    "app_policy.subscription_required": "SubscriptionRequired",
    "app_policy.quota.storage": "StorageQuotaExceeded",
    "app_policy.quota.file_size": "FileSizeLimitExceeded",
    "app_policy.quota.vault_count": "VaultCountExceeded",
    "app_policy.feature.managed_storage_unavailable": "ManagedStorageNotAllowed",
    "app_policy.feature.external_storage_unavailable": "ExternalStorageNotAllowed",
    "feature.external_blob_config_discovered": "ExternalBlobConfigDiscovered",
}


def typed_rejections(parsed: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Add the typed event of each code; unknown codes stay generic.

    The mapping is a user hook. It is a small constant, so it folds into the expression.
    """
    table = TYPED if mapping is None else mapping
    typed = F.lit(None).cast("string")
    for code, name in table.items():
        typed = F.when(F.col("code") == code, F.lit(name)).otherwise(typed)
    generic = F.when(F.col("code").isNotNull(), F.lit("ServerRejected"))
    return parsed.withColumn("typed", F.coalesce(typed, generic))
