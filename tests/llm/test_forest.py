"""The LSH forest against all pairs of a small corpus."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import common, forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_shingles string, component string, region string, kept string"


def shingles(text, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def expected(corpus, percent=85):
    sets = [(d, shingles(t)) for d, t in corpus]
    head = {d: d for d, _ in sets if d is not None}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t:
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = sorted((find(a), find(b)))
                    head[y] = x
    return sorted(((d, len(s), None if d is None else find(d), None if d is None else find(d) == d) for d, s in sets),
                  key=repr)


def corpus(seed, n):
    rnd = random.Random(seed)
    bases = [[f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 6, 40, 120, 300]))] for _ in range(8)]
    out = []
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(words))
            words[at:at + 1] = rnd.choice([["new"], [], ["two", f"n{rnd.randrange(9)}"]])
            words = words or ["x"]
        out.append((rnd.randrange(10 * n), " ".join(words).upper() if rnd.random() < .2 else "\n".join(words)))
    edge = [(None, out[0][1]), (None, None), (-1, None), (-2, ""), (-3, " \t"), (-4, "a b"), (-5, "A\x0bb"), (-6, "a b c"),
            (7, out[1][1]), (7, out[2][1]), (7, out[2][1])]
    return out + edge


def frame(spark, corpus):
    return spark.createDataFrame([(d, t, "c", "c", "c", "c") for d, t in corpus], SCHEMA).repartition(3)


def result(spark, corpus, **options):
    return sorted(map(tuple, forest.near_duplicates(frame(spark, corpus), **options).collect()), key=repr)


def test_near_duplicates(spark):
    rows = corpus(1, 150)
    assert result(spark, rows) == expected(rows)


def test_dense_regions_go_deeper(spark, monkeypatch):
    """Unlike documents in one region, which no chain joins, all reach the deeper levels; links among them stay."""
    common = [f"c{i}" for i in range(100)]
    rnd = random.Random(2)
    rows = [(i, " ".join(common + [f"own{i}_{j}" for j in range(20)])) for i in range(40)]
    rows += [(100 + i, rows[i][1] + f" tail{i}") for i in range(0, 40, 3)]
    rnd.shuffle(rows)
    levels = []
    plain = forest._regions
    monkeypatch.setattr(forest, "PAIRS_PER_MEMBER", 1)
    monkeypatch.setattr(forest, "_regions", lambda nodes, level: levels.append(level) or plain(nodes, level))
    assert result(spark, rows) == expected(rows)
    assert levels == [0, 1]


def test_small_tables_have_few_files(spark, monkeypatch):
    """However many partitions a session shuffles to, small tables are not written as a file for each."""
    files, plain = [], forest.stored

    def counted(*args):
        out = plain(*args)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(forest, "stored", counted)
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for c, value in zip(old, ("60", "false")):
            spark.conf.set(c, value)
        rows = corpus(5, 200)
        assert result(spark, rows) == expected(rows)
    finally:
        for c, value in old.items():
            spark.conf.set(c, value)
    assert len(files) > 5 and max(files) <= 24


def test_texts_that_are_not_asked_for_stay(spark, monkeypatch):
    """Also where no side is small enough to broadcast, whole texts are not dealt out to be compared with ids."""
    plans, plain = {}, forest.stored

    def seen(df, label, *args):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label, *args)

    monkeypatch.setattr(forest, "stored", seen)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = corpus(6, 120)
        assert result(spark, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plans["sets"] and not any("Join" in p for p in plans["sets"])
    assert plans["sketch"] and all(p.count("ArrowEvalPython") >= 2 for p in plans["sketch"])


def test_among(spark):
    """All wanted rows pass, repeated ones too, hardly any other, and no null; many ids are joined."""
    rows = spark.range(-20_000, 20_000).selectExpr("id as doc", "cast(id as string) as text")
    rows = rows.union(rows.where("doc % 1000 = 7")).union(spark.sql("select cast(null as long), 'x'"))
    want = spark.range(-20_000, 20_000, 10).selectExpr("id as doc").union(spark.sql("select cast(7 as long)"))
    for name, value in (("ONE_TASK", 4001), ("ONE_TASK", 0), ("MOST_BITS", 1000)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(common, name, value)
            got = [r.doc for r in common.among(common.stored(want, "ids"), "doc")(rows).collect()]
        assert None not in got and sorted(d for d in got if d % 10 == 0 or d == 7) == sorted([*range(-20_000, 20_000, 10), 7, 7])
        assert len(got) < 4002 + 400
    none = common.stored(want.where("false"), "ids")
    assert common.among(none, "doc")(rows).count() == 0


def test_no_rows(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None), (2, " ")]) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("level", range(len(forest.LEVELS)))
def test_chance_of_a_miss(level):
    """Minhashes agree as often as the sets' similarity, so the stated chance holds."""
    depth, trees, width = forest.LEVELS[level]
    assert (1 - .85 ** depth) ** trees < 1e-8
    pool = np.random.default_rng(level).integers(0, 1 << 63, 60_000).astype(np.uint64) * np.uint64(2)
    a = [pool[i * 300:i * 300 + 276] for i in range(100)]
    b = [pool[i * 300 + 24:i * 300 + 300] for i in range(100)]
    same = (forest.signatures(a, level) == forest.signatures(b, level)).reshape(100, trees, width)
    assert abs(same.mean() - 252 / 300) < .02
    assert abs(same[:, :, :depth].all(2).mean() - .84 ** depth) < .03
