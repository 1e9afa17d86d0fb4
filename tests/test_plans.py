"""Shared plan pieces, with one key holding most of the rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import causal, gates
from tidemark.plans.folds import fold_sorted
from tidemark.plans.ordered import Running, cut, first_per_key, number_rows, running, text_axis
from tidemark.plans.skew import attach, attach_small


@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(20)}", i, rnd.randrange(1000))
            for i in range(3000)]
    return spark.createDataFrame(rows, "k string, seq long, v long")


def test_running_equals_a_plain_window(hot):
    got = running(hot, ["k"], ["seq"], F.floor(F.col("seq") / 97), [
        Running("n", "count"), Running("s", "sum", F.col("v")), Running("m", "max", F.col("v"), before=True),
        Running("lo", "min", F.col("v"))])
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    want = hot.select("*", F.count("*").over(w).alias("n"), F.sum("v").over(w).alias("s"),
                      F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
                      F.min("v").over(w).alias("lo"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_number_rows_descending_and_text_axis(spark, hot):
    got = number_rows(hot, ["k"], [F.desc("seq")], -F.floor(F.col("seq") / 50), "n")
    want = hot.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("seq"))))
    assert got.exceptAll(want.withColumn("n", F.col("n").cast("long"))).count() == 0
    words = spark.createDataFrame([(w,) for w in ("", "a", "ab", "zé", "é", "Z", "b1")], "w string")
    by_text = [r.w for r in words.orderBy("w").collect()]
    assert [r.w for r in words.orderBy(text_axis("w"), "w").collect()] == by_text


def test_a_key_with_nearly_all_rows_of_one_second_is_spread(spark, pieces):
    rnd = random.Random(2)
    rows = [("hot", rnd.randrange(1000), i) if rnd.random() < .9 else (f"k{i % 30}", rnd.randrange(10**12), i)
            for i in range(20000)]
    df = spark.createDataFrame(rows, "k string, ms long, id long")
    assert cut(df, "ms") is None
    pieces(1000)
    piece = cut(df, "ms")
    sizes = [r["count"] for r in df.groupBy("k", piece.alias("b")).count().collect()]
    assert max(sizes) < 1500 and df.select(piece.alias("b")).distinct().count() == 20
    flat = df.orderBy("ms").select("ms", piece.alias("b")).collect()
    assert all(a.b <= b.b for a, b in zip(flat, flat[1:]))
    w = Window.partitionBy("k").orderBy("ms", "id")
    want = df.withColumn("n", F.row_number().over(w).cast("long"))
    got = number_rows(df, ["k"], ["ms", "id"], piece, "n")
    assert got.exceptAll(want).count() == 0 and got.count() == 20000
    back = number_rows(df, ["k"], [F.desc("ms"), "id"], cut(df, -F.col("ms")), "n")
    down = Window.partitionBy("k").orderBy(F.desc("ms"), "id")
    assert back.exceptAll(df.withColumn("n", F.row_number().over(down).cast("long"))).count() == 0


def test_null_keys_places_and_values_in_pieces(spark, pieces):
    rows = [(k, None if i % 9 == 0 else i // 2, None if i % 5 == 0 else i, i)
            for i in range(400) for k in (None, "a", f"r{i % 50}")]
    df = spark.createDataFrame(rows, "k string, at long, v int, id long")
    outs = [Running("n", "count"), Running("s", "sum", F.col("v")), Running("b", "sum", F.col("v"), before=True),
            Running("hi", "max", F.struct("v", "id"), before=True), Running("lo", "min", F.col("v"))]
    want = running(df, ["k"], ["at", "id"], None, outs)
    pieces(60)
    got = running(df, ["k"], ["at", "id"], cut(df, "at"), outs)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert got.exceptAll(want).count() == 0 and got.count() == 1200
    empty = df.where("false")
    assert cut(empty, "at") is None
    same = df.withColumn("at", F.lit(7))
    tied = running(same, ["k"], ["at", "id"], cut(same, "at"), outs)
    assert tied.exceptAll(running(same, ["k"], ["at", "id"], None, outs)).count() == 0
    assert running(empty, ["k"], ["at", "id"], F.lit(0), outs).count() == 0


def test_a_small_scan_starts_no_job(spark):
    small = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert cut(small, "id") is None
    number_rows(small, ["k"], ["id"], cut(small, "id"), "n")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_clocks_take_two_scans(spark, pieces):
    df = spark.createDataFrame([("d", 1, 5, 4, 0)], "device string, seq long, wall long, r_ms long, r_cnt long")
    plan = causal.observe_hlc(df, "device", "wall", "r_ms", "r_cnt", ["seq"])._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Window ") == 2


@pytest.mark.parametrize("limit,least", [(1, 10), (256, 10), (256, 10**6)])
def test_attach_equals_a_left_join(hot, limit, least):
    rows = hot.withColumn("k", F.when(F.col("seq") % 50 != 0, F.col("k")))
    lookup = hot.where("k <> 'k3'").groupBy("k").agg(F.max("v").alias("top"))
    want = rows.join(lookup, "k", "left")
    got = attach(rows, lookup, ["k"], limit, least)
    assert got.count() == 3000
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_hot_keys_are_few_and_largest(hot):
    from tidemark.plans.skew import hot_keys

    assert [r.k for r in hot_keys(hot, ["k"], 256, 500)] == ["hot"]
    assert len(hot_keys(hot, ["k"], 3, 0)) == 3
    assert hot_keys(hot, ["k"], 256, 10**6) == []


def test_semi_and_anti_joins_for_hot_keys(hot):
    from tidemark.plans import skew

    known = hot.where("k in ('hot', 'k1')").select("k")
    assert skew.keep_known(hot, known, ["k"]).count() == hot.where("k in ('hot', 'k1')").count()
    assert skew.drop_known(hot, known, ["k"]).count() == hot.where("k not in ('hot', 'k1')").count()


@pytest.mark.parametrize("seed", [1, 2])
def test_register_join_of_one_file(spark, seed):
    from tests.helpers import frames, keys_of, lattice, random_log

    log = random_log(seed, 80, files=1)
    assert keys_of(causal.register_join(*frames(spark, log))) == lattice(log)


def test_attach_starts_no_job(spark, hot):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    attach(hot, hot.groupBy("k").agg(F.max("v").alias("top")), ["k"])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


@pytest.mark.parametrize("bound", [2, 1000])
def test_attach_small_on_both_sides_of_its_bound(hot, bound):
    lookup = hot.groupBy("k").agg(F.max("v").alias("top"))
    got = attach_small(hot, lookup, ["k"], bound)
    assert got.exceptAll(hot.join(lookup, "k", "left").select(*got.columns)).count() == 0


def test_attach_spreads_a_hot_key(spark, hot):
    lookup = hot.groupBy("k").agg(F.max("v").alias("top"))
    from tidemark.plans import skew

    salts = hot.where("k = 'hot'").withColumn("s", skew._salt(hot)).select("s").distinct().count()
    assert salts > skew.SALTS // 2
    assert lookup.count() > 1


def test_first_per_key_limits_before_the_shuffle(hot):
    df = first_per_key(hot, ["k"], ["seq"])
    plan = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("WindowGroupLimit") >= 2
    assert df.count() == hot.select("k").distinct().count()


def test_cursor_filter_reaches_the_scan(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("server_seq"), F.lit("v").alias("vault_id")).write.parquet(
        str(tmp_path / "r"))
    df = gates.delta_since(spark.read.parquet(str(tmp_path / "r")), 990)
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(server_seq,990)" in plan
    assert df.count() == 9


def test_register_join_has_no_nested_loop(spark):
    from tests.helpers import frames, random_log

    w, c = frames(spark, random_log(1))
    plan = causal.register_join(w, c)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_fold_sorted_reads_groups_of_any_size_in_order(spark):
    rows = [(g, i, f"{g}{i}") for g, n in (("a", 1), ("b", 5000), (None, 2), ("c", 300)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, at long, body string").repartition(7)

    def fold(group):
        first = next(group)
        return {"g": first["g"], "body": ">".join([first["body"], *(r["body"] for r in group if r["at"] < 4)])}

    out = {r.g: r.body for r in fold_sorted(df, ["g"], ["at"], fold, "g string, body string").collect()}
    assert out == {"a": "a0", "b": "b0>b1>b2>b3", None: "None0>None1", "c": "c0>c1>c2>c3"}
    first = fold_sorted(df, ["g"], ["at"], lambda g: next(g) if True else None, "g string, at long, body string")
    assert {(r.g, r.at) for r in first.collect()} == {("a", 0), ("b", 0), (None, 0), ("c", 0)}
    assert fold_sorted(df, ["g"], ["at"], lambda g: None, "g string").count() == 0


def test_record_layout_prunes_keyspaces_and_cursors(spark, tmp_path):
    from tidemark.sources import sinks

    df = spark.range(5000).select(
        F.when(F.col("id") % 10 < 7, "big").otherwise("small").alias("vault_id"), F.lit("config").alias("ns"),
        F.col("id").alias("server_seq"))
    sinks.write_records(df, str(tmp_path / "r"), 8)
    assert len(list((tmp_path / "r" / "vault_id=big" / "ns=config").glob("*.parquet"))) >= 4
    part = gates.delta_since(gates.with_keyspace(spark.read.parquet(str(tmp_path / "r")), "big", "config"), 4000)
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(vault_id" in plan and "GreaterThan(server_seq,4000)" in plan
    assert part.count() == df.where("vault_id = 'big' and server_seq > 4000").count()
