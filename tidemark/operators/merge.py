"""Conflict resolution (M1-M5, M8, M9; hook U1).

``conflicts`` holds every surviving value of a file with more than one:
``(vault_id, file_id, path, ms, cnt, node, blob_ref, tombstone)``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, pairwise
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.hlc import hlc
from ..functions.lines import merge3
from ..functions.paths import classify_text, conflict_copy_path
from ..plans import runs
from ..plans.folds import fold_sorted
from ..plans.skew import attach
from ..session import settle
from . import text
from .causal import FILE, current_values

# A policy gets (accumulated value, next value, base text or None) and returns a dict with
# winner ("ours" | "theirs" | "merged"), strategy, and for "merged" the text.
Policy = Callable[[dict[str, Any], dict[str, Any], str | None], dict[str, Any]]


def conflicts_of(survivors: DataFrame) -> DataFrame:
    return current_values(survivors).where("n_values > 1").drop("n_values")


def _value() -> Column:
    return F.struct(hlc().alias("at"), "path", "blob_ref", "tombstone")


def resolve_same_content(conflicts: DataFrame) -> DataFrame:
    """M1. Files whose values all agree on ref and tombstone: newest value wins."""
    content = F.struct("blob_ref", "tombstone")
    per_file = conflicts.groupBy(*FILE).agg(
        F.min(content).alias("_lo"), F.max(content).alias("_hi"), F.max(_value()).alias("w"))
    return per_file.where("_lo = _hi").select(
        *FILE, "w.at.ms", "w.at.cnt", "w.at.node", "w.blob_ref", F.lit("same-blob").alias("strategy"))


def resolve_add_wins(conflicts: DataFrame) -> DataFrame:
    """M2. Tombstone against edit: newest edit wins, newest tombstone names the copy."""
    per_file = conflicts.groupBy(*FILE).agg(
        F.max(F.when(~F.col("tombstone"), _value())).alias("w"),
        F.max(F.when(F.col("tombstone"), _value())).alias("l"))
    both = per_file.where("w is not null and l is not null")
    return both.select(*FILE, F.col("w.blob_ref").alias("blob_ref"), F.col("l.at.node").alias(
        "loser_node"), conflict_copy_path("w.path", "l.at.ms", "l.at.node").alias("copy_path"),
        F.lit("tombstone-loses").alias("strategy"))


def resolve_lww(conflicts: DataFrame, blobs: DataFrame) -> DataFrame:
    """M3. Live, differing values: newest wins; each loser is a copy, or lossy when its
    blob is not stored anywhere. One row per loser."""
    shape = conflicts.groupBy(*FILE).agg(F.max("tombstone").alias("_t"), F.max(_value()).alias("w"))
    losers = settle(attach(conflicts, shape, FILE).where(
        (~F.col("_t")) & (hlc() < F.col("w.at")) & (F.col("blob_ref") != F.col("w.blob_ref"))))
    stored = blobs.select(F.col("blob_id").alias("blob_ref")).distinct().withColumn(
        "_have", F.lit(True))
    reach = attach(losers, stored, ["blob_ref"])
    return reach.select(
        *FILE, F.col("w.blob_ref").alias("winner_ref"), F.col("blob_ref").alias("loser_ref"),
        conflict_copy_path("w.path", "ms", "node").alias("copy_path"),
        F.when(F.col("_have"), "lww").otherwise("lww-lossy").alias("strategy"))


def resolve(conflicts: DataFrame, blobs: DataFrame, base: DataFrame | None = None,
            texts: DataFrame | None = None, policy: Policy | None = None) -> DataFrame:
    """M4. Ordered pairwise fold per file, stopping at the first pair that cannot merge.

    Without texts and policy the fold has a closed form: values older than the first one
    that differs from the oldest all agree, so that pair decides. With ``texts``
    (``blob_ref, text``) and ``base`` (``FILE, base_ref``) text pairs merge three-way first,
    and a ``policy`` (U1) replaces the pair rule; both fold in one sorted pass over the values.
    """
    if policy is None and texts is None:
        return _resolve_closed(conflicts, blobs)
    return _resolve_folded(conflicts, blobs, base, texts, policy or _default_pair)


def _resolve_closed(conflicts: DataFrame, blobs: DataFrame) -> DataFrame:
    oldest = conflicts.groupBy(*FILE).agg(F.min(_value()).alias("_a"))
    same = ((F.col("blob_ref") == F.col("_a.blob_ref"))
            & (F.col("tombstone") == F.col("_a.tombstone")))
    marked = attach(conflicts, oldest, FILE).withColumn("_same", same)
    turn = marked.groupBy(*FILE).agg(
        F.min(F.when(~F.col("_same"), _value())).alias("b"))
    led = attach(conflicts, settle(turn), FILE)
    pair = led.groupBy(*FILE).agg(
        F.max(F.when(F.col("b").isNull() | (hlc() < F.col("b.at")), _value())).alias("a"),
        F.first("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    newer_is_live = ~b["tombstone"]
    winner = F.when(b.isNull(), a).when(a["tombstone"] & newer_is_live, b).when(
        b["tombstone"], a).otherwise(b)
    loser = F.when(b.isNull(), F.lit(None)).when(b["tombstone"], b).otherwise(a)
    out = settle(pair.select(*FILE, winner.alias("w"), loser.alias("l")).withColumn(
        "blob_ref", F.col("l.blob_ref")))
    stored = blobs.select(F.col("blob_id").alias("blob_ref")).distinct().withColumn(
        "_have", F.lit(True))
    out = attach(out, stored, ["blob_ref"])
    lost = (F.col("blob_ref") != "") & F.col("_have").isNull()
    strategy = (F.when(F.col("l").isNull(), "same-blob")
                .when(F.col("l.tombstone"), "tombstone-loses")
                .when(lost, "lww-lossy").otherwise("lww"))
    return out.select(
        *FILE, F.col("w.path").alias("path"), F.col("w.blob_ref").alias("winner_ref"),
        F.coalesce("l.blob_ref", F.lit("")).alias("loser_ref"),
        F.coalesce(F.when(strategy != "lww-lossy", conflict_copy_path(
            "w.path", "l.at.ms", "l.at.node")), F.lit("")).alias("copy_path"),
        strategy.alias("strategy"))


def _default_pair(ours: dict[str, Any], theirs: dict[str, Any],
                  base: str | None) -> dict[str, Any]:
    clock = lambda v: (v["ms"], v["cnt"], v["node"])
    newer = "ours" if clock(ours) >= clock(theirs) else "theirs"
    if (ours["blob_ref"], ours["tombstone"]) == (theirs["blob_ref"], theirs["tombstone"]):
        return {"winner": newer, "strategy": "same-blob"}
    if ours["tombstone"] != theirs["tombstone"]:
        return {"winner": "theirs" if ours["tombstone"] else "ours",
                "strategy": "tombstone-loses"}
    if base is not None and ours["text"] is not None and theirs["text"] is not None:
        binary = "\0" in ours["text"] or "\0" in theirs["text"]
        merged = None if binary else merge3(base, ours["text"], theirs["text"])
        if merged is not None:
            return {"winner": "merged", "strategy": "3-way-merge", "text": merged}
    return {"winner": newer, "strategy": "lww"}


STATE = ["path", "ms", "cnt", "node", "blob_ref", "tombstone", "text", "reachable"]


_OUTCOME = ("vault_id string, file_id string, path string, winner_ref string, loser_ref string, loser_ms long, "
            "loser_node string, strategy string, text string")


def _resolve_folded(conflicts: DataFrame, blobs: DataFrame, base: DataFrame | None,
                    texts: DataFrame | None, policy: Policy) -> DataFrame:
    spark = conflicts.sparkSession
    if texts is None:
        texts = spark.createDataFrame([], "blob_ref string, text string")
    if base is None:
        base = spark.createDataFrame([], "vault_id string, file_id string, base_ref string")
    stored = blobs.select(F.col("blob_id").alias("blob_ref")).distinct().withColumn(
        "reachable", F.lit(True))
    values = attach(attach(conflicts.select(*FILE, *STATE[:6]), texts, ["blob_ref"]), stored,
                    ["blob_ref"]).select(*FILE, F.lit(1).alias("_part"), *STATE[:7],
                                         F.coalesce("reachable", F.lit(False)).alias("reachable"))
    # Ahead of a file's values: the stamp of the newest and the text all of them came from.
    base_text = base.join(texts.select(F.col("blob_ref").alias("base_ref"), "text"), "base_ref", "left")
    heads = (conflicts.groupBy(*FILE).agg(F.max(F.struct("ms", "cnt")).alias("_top"))
             .join(base_text.select(*FILE, "text"), FILE, "left")
             .select(*FILE, F.lit(0).alias("_part"), F.col("_top.ms").alias("ms"), F.col("_top.cnt").alias("cnt"), "text"))
    rows = values.unionByName(heads, allowMissingColumns=True)

    def fold(group):
        head = next(group)
        state = None
        for value in group:
            ours = {c: value[c] for c in STATE}
            state = {**ours, "strategy": "same-blob", "loser_ref": "", "loser_ms": 0, "loser_node": "",
                     "stop": False} if state is None else _fold_pair(state, ours, head, policy)
            if state["stop"]:
                break
        return {**{k: head[k] for k in FILE}, "winner_ref": state["blob_ref"],
                **{k: state[k] for k in ("path", "loser_ref", "loser_ms", "loser_node", "strategy", "text")}}

    done = fold_sorted(rows, FILE, ["_part", "ms", "cnt", "node"], fold, _OUTCOME)
    copy = conflict_copy_path("path", "loser_ms", "loser_node")
    return done.select(
        *FILE, "path", "winner_ref", "loser_ref",
        F.when((F.col("loser_node") != "") & (F.col("strategy") != "lww-lossy"), copy)
        .otherwise("").alias("copy_path"), "strategy", "text")


def _fold_pair(state: dict[str, Any], theirs: dict[str, Any], head: dict[str, Any],
               policy: Policy) -> dict[str, Any]:
    ours = {c: state[c] for c in STATE}
    out = policy(ours, theirs, head["text"])
    state = dict(state)
    if out["winner"] == "merged":
        # A merge is stamped now, after every value of the file.
        state.update(text=out["text"], blob_ref=hashlib.sha256(out["text"].encode()).hexdigest(),
                     ms=head["ms"], cnt=max(head["cnt"], ours["cnt"]) + 1, tombstone=False, reachable=True,
                     strategy=out["strategy"])
        return state
    winner, loser = (theirs, ours) if out["winner"] == "theirs" else (ours, theirs)
    state.update(winner, strategy=out["strategy"])
    if out["strategy"] != "same-blob":
        if out["strategy"] == "lww" and not loser["tombstone"] and loser["blob_ref"] \
                and not loser["reachable"]:
            state["strategy"] = "lww-lossy"
        state.update(loser_ref=loser["blob_ref"], loser_ms=loser["ms"], loser_node=loser["node"],
                     stop=True)
    return state


def resolve_text(conflicts: DataFrame, texts: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """M9 carried out: ``(FILE, strategy, winner_ref, text)`` of every conflicted text file.

    ``texts`` are the readable blobs ``(blob_ref, text)``; ``sequences`` the entries ``(blob_ref, ms, cnt, node, p_ms,
    p_cnt, p_node, side, value, deleted)`` of those that are character sequences, others are seeded from their
    text. Without a readable live value the file is deleted; values that share history join as sequences, a
    single one stands for itself; others are shown as their line union, for which no value is written, so its
    ``winner_ref`` is empty. An empty text counts as readable.
    """
    values = conflicts.where(classify_text("path") & ~F.col("tombstone")).select(
        F.struct(*FILE).alias("file_id"), hlc().alias("version"), "blob_ref")
    live = settle(values.join(texts.select("blob_ref", "text"), "blob_ref")
                  .select("file_id", "version", "blob_ref", "text"))
    entry = ["ms", "cnt", "node", "p_ms", "p_cnt", "p_node", "side", "value", "deleted"]
    if sequences is None:
        known, raw = None, live
    else:
        known = live.join(sequences, "blob_ref").select("file_id", "version", *entry)
        raw = live.join(sequences.select("blob_ref").distinct(), "blob_ref", "left_anti")
    seeded = text.seed_sequence(raw.select(F.struct("file_id", "version").alias("of"), "text"), "of").select(
        F.col("file_id.file_id").alias("file_id"), F.col("file_id.version").alias("version"), *entry)
    entries = settle(seeded if known is None else known.unionByName(seeded))
    shares = shares_history(entries.select("file_id", F.struct(*text.DOT).alias("dot"),
                                           "version", F.col("value").alias("val")))
    routed = settle(text_strategy(conflicts, texts, shares.select("file_id.*", "shares")))
    files = routed.select(F.struct(*FILE).alias("file_id"), "strategy")

    def of(rows, strategy):
        return rows.join(files.where(F.col("strategy") == strategy).select("file_id"), "file_id", "left_semi")

    union = text.line_union(of(live, "text-union").select("file_id", F.col("text").alias("body")))
    joined = text.sequence_text(text.sequence_join(of(entries.drop("version"), "fugue-join")))
    bodies = union.select("file_id", F.col("body").alias("text")).unionByName(joined)
    out = files.join(bodies, "file_id", "left")
    shown = F.when(F.col("strategy") != "fugue-tombstone", F.coalesce("text", F.lit("")))
    return out.select("file_id.*", "strategy", F.when(F.col("strategy") == "fugue-join", F.sha2(shown, 256))
                      .otherwise("").alias("winner_ref"), shown.alias("text"))


def resolve_files(conflicts: DataFrame, blobs: DataFrame, texts: DataFrame,
                  sequences: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """M4 + M9. ``(FILE, strategy, winner_ref, text)`` of every conflict: text files by `resolve_text`, others folded."""
    is_text = conflicts.where(classify_text("path")).select(*FILE).distinct()
    others = conflicts.join(is_text, FILE, "left_anti")
    folded = resolve(others, blobs, base, None if base is None else texts)
    columns = [*FILE, "strategy", "winner_ref"]
    held = "text" if "text" in folded.columns else F.lit(None).cast("string").alias("text")
    return resolve_text(conflicts, texts, sequences).unionByName(folded.select(*columns, held))


def resolution_report(outcomes: DataFrame) -> DataFrame:
    """M5. Files per strategy, and how many of them lost data."""
    return outcomes.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("strategy") == "lww-lossy").alias("data_loss"))


def shares_history(entries: DataFrame) -> DataFrame:
    """M8. Per file: versions share a dot, and no shared dot has two values.

    Entries are dealt out packed, by file and page of dots, so a large file meets in many tasks.
    """
    kinds = entries.schema
    split = {c: runs.leaves(F.col(c), kinds[c].dataType, f"_{c}") for c in ("dot", "version", "val")}
    lean = entries.select("file_id", runs.page(F.col("dot"), kinds["dot"].dataType).alias("_page"), *sum(split.values(), []))
    at, most_held = [0, *accumulate(map(len, split.values()))], runs.MOST_HELD

    def ids(c: Sequence[runs.Column]) -> np.ndarray:
        """A number for each value, -1 for null."""
        if len(c) == 1:
            return runs.ranked(c[0])
        order, starts = runs.sorted_groups([runs.ranked(x) for x in c])
        out = np.zeros(len(order), np.int64)
        out[starts[1:]] = 1
        out[order] = np.cumsum(out)
        return np.where(c[0].values != 0, out, -1)

    def bounds(c: list[runs.Column]) -> tuple[list[np.ndarray], np.ndarray]:
        """Of each dot the least and the last version and value, as numbers; the rows that have them."""
        dot, version, val = (ids(c[a:b]) for a, b in pairwise(at))
        order, starts = runs.sorted_groups([dot])
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(order)]))
        found, kept = [], []
        for x in (version[order], val[order]):
            low = np.minimum.reduceat(np.where(x < 0, np.iinfo(np.int64).max, x), starts)
            for bound in (low, np.maximum.reduceat(x, starts)):
                hits = np.flatnonzero(x == bound[group])
                kept.append(hits[np.unique(group[hits], return_index=True)[1]])
                found.append(bound)
        return found, order[np.unique(np.concatenate(kept))]

    def fold(rows: Iterator[dict[str, Any]]) -> dict[str, Any]:
        blocks, n = [], 0
        for row in rows:
            blocks.append(runs.decoded(row["_block"]))
            n += row["_n"]
            if n > most_held and len(blocks) > 1:
                c = runs.gathered(blocks)
                kept = bounds(c)[1]
                blocks, n = [[x.take(kept) for x in c]], 0
        low, high, least, most = bounds(runs.gathered(blocks))[0]
        shared, divided, known, told = low < high, least < most, high >= 0, most >= 0
        both = shared & divided
        # As in SQL: false and null is false, true and null is null; a maximum leaves nulls out.
        sure = (known & told) | (known & ~shared) | (told & ~divided)
        return {"file_id": row["file_id"], "_shared": bool(shared.any()) if known.any() else None,
                "_both": bool(both.any()) if sure.any() else None}

    schema = StructType([kinds["file_id"], *StructType.fromDDL("_shared boolean, _both boolean").fields])
    with runs.small_rows(entries.sparkSession):
        pages = settle(fold_sorted(runs.packed(lean, ["file_id", "_page"]), ["file_id", "_page"], [], fold, schema))
    return pages.groupBy("file_id").agg((F.max("_shared") & ~F.max("_both")).alias("shares"))


def text_strategy(conflicts: DataFrame, readable: DataFrame, shares: DataFrame) -> DataFrame:
    """M9. Per conflicted text file: tombstone, line union or sequence join.

    ``readable`` lists refs whose content can be read; ``shares`` is M8 per file.
    """
    ok = readable.select("blob_ref").distinct().withColumn("_ok", F.lit(True))
    texts = attach(conflicts.where(classify_text("path")), ok, ["blob_ref"])
    live = F.col("_ok") & ~F.col("tombstone")
    counts = texts.groupBy(*FILE).agg(F.count_if(live).alias("live"),
                                      F.count(F.lit(1)).alias("n_values"))
    j = counts.join(shares.select(*FILE, "shares"), FILE, "left")
    return j.select(*FILE, "n_values", "live", (
        F.when(F.col("live") == 0, "fugue-tombstone")
        .when((F.col("live") >= 2) & ~F.coalesce("shares", F.lit(False)), "text-union")
        .otherwise("fugue-join")).alias("strategy"))
