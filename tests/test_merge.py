"""Conflict resolution and text merging against brute force."""

import difflib
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lines
from tidemark.operators import merge, text
from tidemark.plans import runs
from tidemark.plans.folds import fold_sorted

CONF = "vault_id string, file_id string, path string, ms long, cnt long, node string, blob_ref string, tombstone boolean"


def conflict(spark, **files):
    rows = [("v", f, f + ".png", ms, 0, n, ref, ref == "") for f, vals in files.items() for ms, n, ref in vals]
    return spark.createDataFrame(rows, CONF)


def stored(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "blob_id string")


FILES = dict(same=[(1, "a", "x"), (2, "b", "x"), (3, "c", "x")], addw=[(1, "a", "x"), (2, "b", "")],
             addw2=[(1, "a", ""), (2, "b", "x")], lww=[(1, "a", "x"), (2, "b", "y")],
             lossy=[(1, "a", "gone"), (2, "b", "y")],
             t6=[(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", "z"), (5, "e", "")])
WANT = {"same": ("same-blob", "x", ""), "addw": ("tombstone-loses", "x", ""), "addw2": ("tombstone-loses", "x", ""),
        "lww": ("lww", "y", "x"), "lossy": ("lww-lossy", "y", "gone"), "t6": ("lww", "y", "x")}


def test_t6_fold_stops_at_the_first_pair_it_cannot_merge(spark):
    out = merge.resolve(conflict(spark, **FILES), stored(spark, "x", "y", "z"))
    assert {r.file_id: (r.strategy, r.winner_ref, r.loser_ref) for r in out.collect()} == WANT
    report = {r.strategy: (r.files, r.data_loss) for r in merge.resolution_report(out).collect()}
    assert report == {"same-blob": (1, 0), "tombstone-loses": (2, 0), "lww": (2, 0), "lww-lossy": (1, 1)}


def test_rounds_agree_with_the_closed_form(spark):
    args = conflict(spark, **FILES), stored(spark, "x", "y", "z")
    cols = ["file_id", "winner_ref", "loser_ref", "copy_path", "strategy"]
    closed = merge.resolve(*args).select(cols)
    rounds = merge.resolve(*args, policy=merge._default_pair).select(cols)
    assert sorted(closed.collect()) == sorted(rounds.collect())


def test_three_way_fold_over_three_values(spark):
    conf = conflict(spark, f=[(1, "a", "r1"), (2, "b", "r2"), (3, "c", "r3")])
    texts = spark.createDataFrame([("r0", "1\n2\n3\n4\n5\n6"), ("r1", "A\n2\n3\n4\n5\n6"), ("r2", "1\n2\nB\n4\n5\n6"),
                                   ("r3", "1\n2\n3\n4\n5\nC")], "blob_ref string, text string")
    base = spark.createDataFrame([("v", "f", "r0")], "vault_id string, file_id string, base_ref string")
    r = merge.resolve(conf, stored(spark), base, texts).head()
    assert (r.strategy, r.text) == ("3-way-merge", "A\n2\nB\n4\n5\nC")
    assert r.winner_ref == hashlib.sha256(r.text.encode()).hexdigest()


def test_overlapping_edits_fall_back_to_lww(spark):
    conf = conflict(spark, f=[(1, "a", "r1"), (2, "b", "r2")])
    texts = spark.createDataFrame([("r0", "1\n2"), ("r1", "1\nX"), ("r2", "1\nY")], "blob_ref string, text string")
    base = spark.createDataFrame([("v", "f", "r0")], "vault_id string, file_id string, base_ref string")
    r = merge.resolve(conf, stored(spark, "r1", "r2"), base, texts).head()
    assert (r.strategy, r.winner_ref, r.loser_ref) == ("lww", "r2", "r1")


def test_a_merge_is_newer_than_the_values_after_it(spark):
    conf = conflict(spark, f=[(1, "a", "r1"), (2, "b", "r2"), (3, "c", "r3")])
    texts = spark.createDataFrame([("r0", "1\n2\n3\n4"), ("r1", "A\n2\n3\n4"), ("r2", "1\n2\nB\n4"), ("r3", "X\n2\n3\n4")],
                                  "blob_ref string, text string")
    base = spark.createDataFrame([("v", "f", "r0")], "vault_id string, file_id string, base_ref string")
    r = merge.resolve(conf, stored(spark, "r3"), base, texts).head()
    assert (r.strategy, r.text, r.loser_ref) == ("lww", "A\n2\nB\n4", "r3")


def test_policy_hook(spark):
    remove = lambda ours, theirs, base: {"winner": "ours" if ours["tombstone"] else "theirs", "strategy": "remove-wins"}
    out = merge.resolve(conflict(spark, f=[(1, "a", ""), (2, "b", "x")]), stored(spark), policy=remove)
    assert (out.head().winner_ref, out.head().strategy) == ("", "remove-wins")


def plain_union(x, y):
    """Textbook dynamic program over both line lists, independent of the array version."""
    a, b = x.split("\n"), y.split("\n")
    best = {}
    for i in range(len(a), -1, -1):
        for j in range(len(b), -1, -1):
            if i == len(a) or j == len(b):
                best[i, j] = 0
            else:
                best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
    return best[0, 0]


@pytest.mark.parametrize("seed", range(8))
def test_common_lines_are_longest(seed):
    rnd = random.Random(seed)
    a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(1, 14))] for _ in range(2))
    found = lines._common_lines(a, b)
    assert len(found) == plain_union("\n".join(a), "\n".join(b))
    for seq in (a, b):
        it = iter(seq)
        assert all(c in it for c in found)


def test_t12_union_is_order_free_and_lossless(spark):
    texts = ["# t\nshared\nours", "# t\nshared\ntheirs\nmore", "# t\nother", "# t\nother"]
    perms = enumerate(itertools.permutations(texts[:3]))
    rows = [(n, t) for n, perm in perms for t in (*perm, texts[3], "")]
    df = spark.createDataFrame(rows, "file_id long, body string")
    results = {r.body for r in text.line_union(df).collect()}
    assert len(results) == 1
    merged = results.pop().split("\n")
    assert set(merged) == {"# t", "shared", "ours", "theirs", "more", "other"} and merged.count("# t") == 1


def test_large_versions_are_merged(spark):
    shared = [f"line {i}" for i in range(500)]
    x, y = shared[:250] + ["ours"] + shared[250:], shared[:400] + ["theirs"] + shared[400:]
    assert len(x) * len(y) > 200_000
    df = spark.createDataFrame([(1, "\n".join(t)) for t in (x, y)], "file_id long, body string")
    (got,) = [r.body.split("\n") for r in text.line_union(df).collect()]
    assert got == shared[:250] + ["ours"] + shared[250:400] + ["theirs"] + shared[400:]


def test_nul_behind_the_head_is_not_merged():
    value = lambda ms, t: dict(ms=ms, cnt=0, node="n", blob_ref=t, tombstone=False, text=t)
    base = "a\n" + "x" * 5000 + "\nb"
    ours, theirs = base + "\nours\0", "theirs\n" + base
    assert merge._default_pair(value(1, ours.replace("\0", "")), value(2, theirs), base)["winner"] == "merged"
    assert merge._default_pair(value(1, ours), value(2, theirs), base) == {"winner": "theirs", "strategy": "lww"}


def test_t12_budget_concatenates():
    x, y = "\n".join(map(str, range(500))), "\n".join(map(str, range(401)))
    assert lines.union_lines(x, y, 200_000) == x + "\n" + y
    assert lines.union_lines(x, y) == x
    assert lines.union_lines(x, y, 10**9) == x
    assert lines.union_lines(x, x) == x


@pytest.mark.parametrize("seed", range(6))
def test_char_edits_rebuild_the_new_text(seed):
    rnd = random.Random(seed)
    old = "".join(rnd.choice("ab\né😀") for _ in range(60))
    new = "".join(c for c in old if rnd.random() > 0.2) + rnd.choice(["", "tail\n"])
    ops = lines.char_edits(old, new)
    assert lines.apply_edits(old, ops) == new
    assert lines.char_edits(old, old) == []


def test_merge3_cases():
    assert lines.merge3("a\nb\nc", "a\nb\nc\nd", "x\na\nb\nc") == "x\na\nb\nc\nd"
    assert lines.merge3("a\nb\nc", "a\nB\nc", "a\nB\nc") == "a\nB\nc"
    assert lines.merge3("a\nb\nc", "a\nX\nc", "a\nY\nc") is None
    assert difflib.SequenceMatcher(None, "", "").ratio() == 1.0


SEQ = "file_id long, ms long, cnt long, node string, p_ms long, p_cnt long, p_node string, side string, value string, deleted boolean"


def random_tree(seed, n, file_id=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        dot = (rnd.choice([0, 86_400_000, 5]) if i else 0, i, "abc"[i % 3])
        parent = None if i == 0 or rnd.random() < 0.1 else rows[rnd.randrange(len(rows))][1:4]
        side = "R" if parent is None else rnd.choice("LR")
        rows.append((file_id, *dot, *(parent or (None, None, None)), side, chr(97 + i % 26), rnd.random() < 0.3))
    return rows


def walk(rows):
    kids = {}
    for r in rows:
        kids.setdefault((r[4:7] if r[4] is not None else None, r[7]), []).append(r)
    out = []

    def visit(r):
        for k in sorted(kids.get((r[1:4], "L"), []), key=lambda x: x[1:4]):
            visit(k)
        if not r[9]:
            out.append(r[8])
        for k in sorted(kids.get((r[1:4], "R"), []), key=lambda x: x[1:4]):
            visit(k)

    for root in sorted(kids.get((None, "R"), []), key=lambda x: x[1:4]):
        visit(root)
    return "".join(out)


def test_tree_projection_equals_a_recursive_walk(spark):
    trees = {i: random_tree(i, n, i) for i, n in ((1, 1), (2, 7), (3, 60))}
    trees[4] = [(4, 0, i, "seed", *((0, i - 1, "seed") if i > 1 else (None,) * 3), "R", chr(96 + i), i == 2)
                for i in range(1, 9)]
    df = spark.createDataFrame([r for rows in trees.values() for r in rows], SEQ)
    got = {r.file_id: r.text for r in text.sequence_text(df).collect()}
    want = {k: walk(v) for k, v in trees.items()}
    assert got == {k: v for k, v in want.items() if v}


def test_entries_without_their_parent_still_come_out(spark):
    trees = {i: [r for n, r in enumerate(random_tree(i, 60, i)) if n % 4 != i % 4] for i in (1, 2, 3)}
    df = spark.createDataFrame([r for rows in trees.values() for r in rows], SEQ)
    got = {r.file_id: r.text for r in text.sequence_text(df).collect()}

    def hung(rows):
        known = {r[1:4] for r in rows}
        return [r if r[4] is None or r[4:7] in known else (*r[:4], None, None, None, "R", *r[8:]) for r in rows]

    assert got == {k: walk(hung(v)) for k, v in trees.items()}
    assert all(len(got[k]) == sum(not r[9] for r in v) for k, v in trees.items())


def test_pieces_stay_bounded(spark):
    df = spark.createDataFrame([(1, "x" * 1000)], "file_id long, text string")
    pieces = text.sequence_pieces(text.seed_sequence(df), 256)
    assert sorted((r.piece_no, len(r.piece)) for r in pieces.collect()) == [(0, 256), (1, 256), (2, 256), (3, 232)]


def test_join_is_symmetric_and_never_doubles(spark):
    seed = text.seed_sequence(spark.createDataFrame([(1, "héllo😀")], "file_id long, text string"))
    edited = seed.withColumn("deleted", F.col("cnt") == 2)
    ab, ba = (text.sequence_text(text.sequence_join(*p)).head().text for p in ((seed, edited), (edited, seed)))
    assert ab == ba == "hllo😀"
    assert text.sequence_text(text.sequence_join(seed, seed)).head().text == "héllo😀"


def test_prune_keeps_what_kept_entries_hang_on(spark):
    rows = random_tree(9, 60)
    df = spark.createDataFrame(rows, SEQ)
    frontier = {"a": (0, 40), "b": (5, 10)}
    fr = spark.createDataFrame([(n, *h) for n, h in frontier.items()], "node string, ms long, cnt long")
    keep = {r[1:4] for r in rows if not (r[9] and r[3] in frontier and r[1:3] <= frontier[r[3]])}
    parent = {r[1:4]: r[4:7] for r in rows}
    for d in list(keep):
        while parent[d][0] is not None:
            d = parent[d]
            keep.add(d)
    after = text.prune_tombstones(df, fr)
    assert {(r.ms, r.cnt, r.node) for r in after.collect()} == keep
    assert text.sequence_text(after).head().text == walk(rows)
    dropped = text.prune_report(df, after).collect()
    assert sum(r.dropped for r in dropped) == len(rows) - len(keep)


def test_prune_goes_by_the_vault_of_an_entry(spark):
    """Frontiers of two vaults: nothing doubles, and one vault's frontier frees nothing in the other."""
    rows = [r for seed in (9, 10) for r in random_tree(seed, 40)]
    one = spark.createDataFrame(random_tree(9, 40), SEQ)
    both = one.withColumn("vault_id", F.lit("v")).unionByName(one.withColumn("vault_id", F.lit("u")))
    fr = spark.createDataFrame([("v", "a", 0, 40), ("v", "b", 5, 10), ("u", "a", 0, 3)],
                               "vault_id string, node string, ms long, cnt long")
    after = text.prune_tombstones(both, fr)
    for v in "vu":
        alone = text.prune_tombstones(one, fr.where(F.col("vault_id") == v).drop("vault_id"))
        got = after.where(F.col("vault_id") == v).select(*one.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, alone.collect()), key=repr)
    assert rows and {r.vault_id for r in text.prune_report(both, after).collect()} <= {"v", "u"}
    with pytest.raises(ValueError):
        text.prune_tombstones(one, fr)


def conflict_values(spark, **files):
    """Values ``(ms, ref)`` of note files; an empty ref is a tombstone."""
    rows = [("v", f, f"{f}.md", ms, 0, f"n{ms}", ref, ref == "") for f, values in files.items() for ms, ref in values]
    return spark.createDataFrame(rows, "vault_id string, file_id string, path string, ms long, cnt long, node string, "
                                       "blob_ref string, tombstone boolean")


def test_text_conflicts_go_by_their_strategy(spark):
    c = conflict_values(spark, gone=[(1, ""), (2, "lost")], one=[(1, ""), (2, "x")], apart=[(1, "x"), (2, "y")],
                        kin=[(1, "s1"), (2, "s2")], copies=[(1, "x"), (2, "x")])
    texts = spark.createDataFrame([("x", "a\nb"), ("y", "a\nc"), ("s1", "hi1"), ("s2", "hi2")], "blob_ref string, text string")
    base = text.seed_sequence(spark.createDataFrame([("s1", "hi"), ("s2", "hi")], "file_id string, text string"))
    own = spark.createDataFrame([("s1", 1, 1, "p", 0, 2, "seed", "R", "1", False), ("s2", 2, 1, "q", 0, 2, "seed", "R", "2", False)],
                                SEQ.replace("file_id long", "file_id string"))
    sequences = base.unionByName(own).withColumnRenamed("file_id", "blob_ref")
    got = {r.file_id: r for r in merge.resolve_text(c, texts, sequences).collect()}
    assert {f: r.strategy for f, r in got.items()} == {
        "gone": "fugue-tombstone", "one": "fugue-join", "apart": "text-union", "kin": "fugue-join", "copies": "fugue-join"}
    assert got["gone"].text is None and got["gone"].winner_ref == ""
    assert got["one"].text == got["copies"].text == "a\nb"
    assert sorted(got["apart"].text.split("\n")) == ["a", "b", "c"] and got["apart"].winner_ref == ""
    assert sorted(got["kin"].text) == sorted("hi12") and got["kin"].text.startswith("hi")
    assert got["kin"].winner_ref == hashlib.sha256(got["kin"].text.encode()).hexdigest()
    report = merge.resolution_report(merge.resolve_files(c, spark.createDataFrame([], "blob_id string"), texts, sequences))
    assert {r.strategy: r.files for r in report.collect()} == {"fugue-tombstone": 1, "fugue-join": 3, "text-union": 1}


def test_shared_history(spark):
    rows = [(1, 0, 1, "a"), (1, 1, 1, "a"), (2, 0, 1, "a"), (2, 1, 1, "b"), (3, 0, 1, "a"), (3, 1, 2, "a")]
    df = spark.createDataFrame(rows, "file_id long, version long, dot long, val string")
    assert {r.file_id: r.shares for r in merge.shares_history(df).collect()} == {1: True, 2: False, 3: False}


def test_shared_history_is_dealt_out_packed(spark, monkeypatch):
    """M8: two versions of 30 000 characters meet as a few blocks; before, each character was a row of the shuffle."""
    dealt = []
    monkeypatch.setattr(merge, "fold_sorted", lambda rows, *a: (dealt.append(rows.count()), fold_sorted(rows, *a))[1])
    texts = spark.createDataFrame([(1, 0, "ab" * 15_000), (1, 1, "ab" * 14_999 + "ac")], "file_id long, version long, text string")
    df = texts.select("file_id", "version", F.posexplode(F.split("text", "")).alias("dot", "val"))
    assert [tuple(r) for r in merge.shares_history(df).collect()] == [(1, False)]
    assert [tuple(r) for r in merge.shares_history(df.where("dot < 29999")).collect()] == [(1, True)]
    assert dealt and max(dealt) <= 8


@pytest.mark.parametrize("held", [2, 1 << 20])
def test_shared_history_of_any_rows(spark, monkeypatch, held):
    """M8: nulls, rows in any order, dots that are structs, against an aggregate of plain rows."""
    monkeypatch.setattr(runs, "MOST_HELD", held)
    rnd = random.Random(held)
    rows = [(rnd.choice([None, *range(12)]), rnd.choice([None, 0, 1, 1 << 40, -5]), rnd.choice([None, -1, 0, 1, 70_000]),
             rnd.choice([None, "x", "x", "y"])) for _ in range(260)]
    df = spark.createDataFrame(rows, "file_id long, version long, dot long, val string").repartition(3)
    dots = df.withColumn("dot", F.when(F.col("dot") != 1, F.struct("dot", F.lit("n").alias("node"))))
    for x in (df, dots):
        per_dot = x.groupBy("file_id", "dot").agg((F.min("version") < F.max("version")).alias("a"), (F.min("val") < F.max("val")).alias("b"))
        want = per_dot.groupBy("file_id").agg((F.max("a") & ~F.max(F.col("a") & F.col("b"))).alias("shares"))
        assert sorted(map(repr, merge.shares_history(x).collect())) == sorted(map(repr, want.collect()))


def test_digest_of_entries(spark, monkeypatch):
    """Counters in any order, twice and null, values of several letters; a text goes as blocks, not as characters."""
    dealt = []
    monkeypatch.setattr(text, "fold_sorted", lambda rows, *a: (dealt.append(rows.count()), fold_sorted(rows, *a))[1])
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, None]), rnd.choice([None, 1, 2, 3, 70_000, 140_000]), rnd.choice([None, 1]), rnd.choice(["ab", "c", None, "é😀"]))
            for _ in range(80)] + [(3, 1, None, None)]
    df = spark.createDataFrame(rows, "file_id long, cnt long, p_cnt long, value string").repartition(3)
    got = {r.file_id: tuple(r)[1:] for r in text.sequence_digest(df).collect()}
    for f in (1, 2, 3, None):
        own = sorted(((-1 if c is None else c, p, v or "") for g, c, p, v in rows if g == f), key=lambda r: (r[0], r[2]))
        cnts = [c for c, _, _ in own if c >= 0]
        value = hashlib.sha256("".join(v for _, _, v in own).encode()).hexdigest() if f != 3 else None
        assert got[f] == (len(own), min(cnts), max(cnts), sum(p is None for _, p, _ in own), value)
    dealt.clear()
    seed = text.seed_sequence(spark.createDataFrame([(1, "ab" * 15_000)], "file_id long, text string"))
    assert tuple(text.sequence_digest(seed).head()) == (1, 30_000, 1, 30_000, 1, hashlib.sha256(b"ab" * 15_000).hexdigest())
    assert dealt and max(dealt) <= 4


@pytest.mark.parametrize("held", [2, 1 << 20])
def test_join_of_any_entries(spark, monkeypatch, held):
    """Nulls and dots with several parents, against an aggregate of plain rows."""
    monkeypatch.setattr(runs, "MOST_HELD", held)
    rnd = random.Random(held)
    pick = lambda *x: rnd.choice([None, *x])
    rows = [(pick(1, 2), rnd.choice([0, 0, 5, 1 << 40]), rnd.choice([1, 2, 3]), rnd.choice("ab"), pick(0, 0), pick(0, 1, 2), pick("a", "a", "b"),
             pick("R", "R", "L"), pick("x", "é", "ab"), pick(True, False)) for _ in range(400)]
    a = spark.createDataFrame(rows[:200], SEQ).repartition(2)
    b = spark.createDataFrame(rows[200:], SEQ)
    want = a.unionByName(b).groupBy("file_id", "ms", "cnt", "node").agg(
        F.min(F.struct("p_ms", "p_cnt", "p_node", "side", "value")).alias("e"), F.max("deleted").alias("deleted"))
    want = want.select("file_id", "ms", "cnt", "node", "e.*", "deleted")
    got = text.sequence_join(a, b)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_join_and_text_are_dealt_out_packed(spark, monkeypatch):
    """Two copies of 30 000 characters are dealt out, and kept, as a few blocks."""
    dealt = []
    monkeypatch.setattr(text, "fold_sorted", lambda rows, *a: (dealt.append(rows.count()), fold_sorted(rows, *a))[1])
    seed = text.seed_sequence(spark.createDataFrame([(1, "ab" * 15_000)], "file_id long, text string"))
    gone = seed.withColumn("deleted", F.col("cnt") == 2)
    joined = text.sequence_join(seed, gone)
    assert joined.count() == 30_000
    assert text.sequence_text(joined).head().text == "a" + "ab" * 14_999
    assert len(dealt) == 2 and max(dealt) <= 8


@pytest.mark.parametrize("most", [20, 1 << 20])
def test_large_files_are_read_out_by_joins(spark, monkeypatch, most):
    """Whether a file is read out by one task or by joins, its text is the same; a chain, too."""
    monkeypatch.setattr(text, "MOST_CHAIN", most)
    monkeypatch.setattr(text, "MOST_TREE", most)
    trees = {i: random_tree(i, n, i) for i, n in ((1, 10), (2, 50))}
    trees[3] = [(3, 0, i, "seed", *((0, i - 1, "seed") if i > 1 else (None,) * 3), "R", chr(96 + i), i == 2) for i in range(1, 26)]
    df = spark.createDataFrame([r for rows in trees.values() for r in rows], SEQ)
    assert {r.file_id: r.text for r in text.sequence_text(df).collect()} == {k: walk(v) for k, v in trees.items()}


def test_tree_entries_that_come_twice_stand_side_by_side(spark):
    """Rows of one dot share its place; before, they made the tour endless."""
    rows = [r for r in random_tree(4, 30) if not r[9]]
    df = spark.createDataFrame(rows + rows, SEQ)
    once = text.sequence_text(spark.createDataFrame(rows, SEQ)).head().text
    assert text.sequence_text(df).head().text == "".join(c * 2 for c in once)


def test_edit_plan(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "", "b"), (3, "a", "x" * 3000), (4, "ab", "ac")],
                               "file_id long, old string, new string")
    plan, edits = text.text_edits(df, text.DIFF_BUDGET)
    assert {r.file_id: r.action for r in plan.collect()} == {1: "noop", 2: "seed", 3: "reseed", 4: "edit"}
    assert {r.file_id for r in edits.collect()} == {4}


def test_repair_counts(spark):
    df = spark.createDataFrame([("a.md", "text"), (".x/b.md", "t"), ("c.png", "t"), ("d.txt", None), ("e", "ab\0c")],
                               "path string, content string")
    seeds, report = text.repair(df)
    r = report.head()
    assert (r.total, r.repaired, r.failed) == (3, 1, 2) and seeds.count() == 4
