"""Plans, caps, promo and discount codes, code batches, reports."""

import pytest
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import accounts, codes, ops

T = datetime(2001, 1, 1)


def test_t11_null_is_unlimited_and_zero_denies(spark):
    up = spark.createDataFrame([(u, s, 100, "managed") for u in (1, 2, 3) for s in (1, 2)],
                               "user_id long, seq long, size long, storage string")
    caps = spark.createDataFrame([(1, True, True, None, None), (2, True, True, 0, 0), (3, True, False, 1000, 150)],
                                 "user_id long, managed boolean, external boolean, max_file long, quota long")
    usage = spark.createDataFrame([(3, 10)], "user_id long, used_bytes long")
    got = {(r.user_id, r.seq): r.code for r in accounts.enforce_caps(up, usage, caps).collect()}
    assert got == {(1, 1): "", (1, 2): "", (2, 1): "app_policy.quota.file_size", (2, 2): "app_policy.quota.file_size",
                   (3, 1): "", (3, 2): "app_policy.quota.storage"}


def test_no_plan_is_denied(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    subs = spark.createDataFrame([(9, 2, "p", "O", datetime(2002, 1, 1))], "sub_id long, user_id long, plan_id string, status string, ends timestamp")
    plans = spark.createDataFrame([("p", True, False, None, 5, None)],
                                  "plan_id string, managed boolean, external boolean, max_vaults int, max_file long, quota long")
    got = {r.user_id: (r.managed, r.max_vaults, r.max_file, r.quota) for r in
           accounts.effective_caps(users, subs, plans, F.lit(T)).collect()}
    assert got == {1: (False, 0, 0, 0), 2: (True, None, 5, None)}


CODE = ("code string, percent int, kopecks long, max_discount int, min_order int, only_plan string, only_user long, "
        "max_redemptions int, max_per_user int, is_active boolean, campaign string, starts_at timestamp, expires_at timestamp")


def code(name, **kw):
    base = dict(percent=10, kopecks=None, max_discount=None, min_order=None, only_plan=None, only_user=None,
                max_redemptions=None, max_per_user=1, is_active=True, campaign="c", starts_at=None, expires_at=None)
    return (name, *{**base, **kw}.values())


def test_each_reason_in_its_order(spark):
    late, early = datetime(2002, 1, 1), datetime(2000, 1, 1)
    table = spark.createDataFrame([
        code("OK"), code("Off", is_active=False, expires_at=early), code("Soon", starts_at=late), code("Old", expires_at=T),
        code("Full", max_redemptions=1, only_plan="zz"), code("Plan", only_plan="zz", only_user=9), code("User", only_user=9, min_order=9999),
        code("Min", min_order=9999), code("Mine", max_per_user=1)], CODE)
    tries = ["ok", "nope", "off", "soon", "old", "full", "plan", "user", "min", "mine"]
    orders = spark.createDataFrame([(i, i, 1, c, "p", 1000, T) for i, c in enumerate(tries)],
                                   "seq long, order_id long, user_id long, typed_code string, plan_id string, original_kopecks long, at_ts timestamp")
    past = spark.createDataFrame([("full", 5), ("mine", 1)], "code_key string, user_id long")
    got = {r.typed_code: r.reason for r in codes.preview_discounts(orders, table, past).collect()}
    assert [got[c] for c in tries] == ["", *codes.REASONS]


def test_discount_arithmetic(spark):
    rows = [(1, 999, 15, None, None, ""), (2, 1000, 50, None, 300, ""), (3, 100, None, 500, None, ""), (4, 100, None, 30, None, ""),
            (5, 100, 50, None, None, "wrong_user"), (6, 100, 100, None, None, "")]
    df = spark.createDataFrame(rows, "seq long, original_kopecks long, percent int, kopecks long, max_discount int, reason string")
    got = {r.seq: (r.discount_kopecks, r.final_kopecks) for r in codes.apply_discount(df).collect()}
    assert got == {1: (149, 850), 2: (300, 700), 3: (100, 0), 4: (30, 70), 5: (0, 100), 6: (100, 0)}


def test_promo_caps_in_arrival_order(spark):
    table = spark.createDataFrame([code("A", max_redemptions=2)], CODE)
    tries = [(1, 7, "a"), (2, 7, "A"), (3, 8, "a"), (4, 9, "a"), (5, 1, "zz")]
    att = spark.createDataFrame([(*t, T) for t in tries], "seq long, user_id long, typed_code string, at_ts timestamp")
    none = spark.createDataFrame([], "code_key string, user_id long")
    assert [r.seq for r in codes.redeem_promos(att, table, none, 2).orderBy("seq").collect()] == [1, 3]
    past = spark.createDataFrame([("a", 8)], "code_key string, user_id long")
    assert [r.seq for r in codes.redeem_promos(att, table, past, 2).orderBy("seq").collect()] == [1]


def test_promo_redeemable_bounds(spark):
    df = spark.createDataFrame([(True, T, None, 0), (True, datetime(2001, 1, 2), 3, 2), (True, None, 3, 3), (False, None, None, 0)],
                               "is_active boolean, expires_at timestamp, max_redemptions int, redeemed int")
    assert [r.redeemable for r in codes.promo_redeemable(df, F.lit(T)).collect()] == [False, True, False, False]


def test_either_promo_gate_is_enough(spark):
    users = spark.createDataFrame([(1, "a@x"), (2, "b@x")], "user_id long, email string")
    plans = spark.createDataFrame([("p", "Code"), ("q", None)], "plan_id string, required_code string")
    allowed = spark.createDataFrame([("q", "a@x")], "plan_id string, email string")
    tries = spark.createDataFrame([(1, 1, "p", "cOdE"), (2, 1, "p", "no"), (3, 1, "q", ""), (4, 2, "q", "")],
                                  "attempt_id long, user_id long, plan_id string, code string")
    got = {r.attempt_id: r.eligible for r in accounts.promo_eligible(users, plans, allowed, tries).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_grants_revocations_roles_trials(spark):
    subs = spark.createDataFrame([(1, 1, "p", "O", T, T, 5)],
                                 "sub_id long, user_id long, plan_id string, status string, started timestamp, ends timestamp, amount_kopecks long")
    plans = spark.createDataFrame([("p", 30)], "plan_id string, period_days int")
    grants = spark.createDataFrame([(2, 1, "p", T, None, "gift"), (3, 1, "p", T, 7, "gift")],
                                   "sub_id long, user_id long, plan_id string, at timestamp, days int, reason string")
    after = accounts.apply_grants(subs, grants, plans)
    assert {r.sub_id: (r.ends - T).days for r in after.collect()} == {1: 0, 2: 30, 3: 7}
    gone = spark.createDataFrame([(2,), (2,), (99,)], "sub_id long")
    assert {r.sub_id for r in accounts.apply_revocations(after, gone).where("revoked").collect()} == {2}
    users = spark.createDataFrame([(1, "user")], "user_id long, role string")
    ch = spark.createDataFrame([(1, 1, "admin"), (1, 2, "user"), (1, 3, "admin")], "user_id long, seq long, new_role string")
    assert [r.previous_role for r in accounts.role_changes(users, ch).orderBy("seq").collect()] == ["user", "admin", "user"]
    signups = spark.createDataFrame([(1, 5, T), (1, 6, T), (2, 7, T)], "user_id long, event_id long, ts timestamp")
    had = spark.createDataFrame([(2,)], "user_id long")
    assert [(r.user_id, r.event_id) for r in accounts.trial_grants(signups, had).collect()] == [(1, 5)]


def test_code_batch_is_distinct_and_repeatable(spark):
    a = [r.code for r in codes.code_batch(spark, 500, "X", "s").collect()]
    assert len(set(a)) == 500 and all(c.startswith("X-") for c in a)
    assert a == [r.code for r in codes.code_batch(spark, 500, "X", "s").collect()]
    assert set(a).isdisjoint(r.code for r in codes.code_batch(spark, 500, "X", "other").collect())


def test_reports(spark):
    ev = spark.createDataFrame([("d", T, 1, "pulling"), ("d", T, 2, "note"), ("e", T, 3, "error"), ("e", T, 4, "session_expired")],
                               "device string, ts timestamp, event_id long, kind string")
    assert {r.device: r.status for r in ops.device_status(ev).collect()} == {"d": "pulling", "e": "auth_expired"}
    fe = spark.createDataFrame([("d", "a", T, 1, "mark"), ("d", "a", T, 2, "clear"), ("d", "b", T, 3, "mark"), ("e", "c", T, 4, "clear")],
                               "device string, path string, ts timestamp, event_id long, kind string")
    assert [r.path for r in ops.pending_files(fe).collect()] == ["b"]
    assert {r.device: r.pending for r in ops.pending_flags(fe).collect()} == {"d": 1, "e": 0}
    tasks = spark.createDataFrame([("k", 1, "pull"), ("k", 2, "push"), ("j", 3, "pull")], "task string, n long, grp string")
    assert {r.task: r.grp for r in ops.coalesce_latest(tasks, "task", "n").collect()} == {"k": "push", "j": "pull"}


def simulate_status(events, now):
    """Runs the timer as a device does."""
    state, timer, pending = "off", None, False
    for ms, _, kind, code, flag in sorted(e for e in events if e[0] <= now):
        if timer is not None and timer < ms:
            state, timer = "idle", None
        if kind == "pending":
            pending = flag
            continue
        if kind == "server_rejected" and not (code or "").startswith(("auth.", "app_policy.")):
            continue
        shown = "connecting" if kind in ("started", "connecting") else ops.STATUS.get(kind)
        if shown is None:
            continue
        state = shown
        if kind not in ops.LEAVES_TIMER:
            timer = ms + ops.FALLS_BACK_MS[kind] if kind in ops.FALLS_BACK_MS else None
    if timer is not None and timer <= now:
        state = "idle"
    return state, pending


@pytest.mark.parametrize("rows", [20, None])
def test_status_falls_back_in_time(spark, pieces, rows):
    import random

    rnd = random.Random(8)
    kinds = [*ops.STATUS, "started", "connecting", "pending", "note", "file_pushed", "error", "blob_upload_done"]
    log = {d: [(rnd.randrange(60_000), n, rnd.choice(kinds), rnd.choice(["auth.x", "app_policy.y", "rpc.z", None]),
                rnd.random() < .5) for n in range(60)] for d in ("a", "b")}
    probes = [(n, d, rnd.randrange(70_000)) for n, d in enumerate("abc" * 60)]
    ev = spark.createDataFrame([(d, *e) for d, es in log.items() for e in es],
                               "device string, ms long, event_id long, kind string, code string, pending boolean")
    if rows:
        pieces(rows)
    got = {r.probe_id: (r.status, r.pending) for r in ops.status_at(
        ev, spark.createDataFrame(probes, "probe_id long, device string, ms long")).collect()}
    assert got == {n: simulate_status(log.get(d, []), ms) for n, d, ms in probes}
