"""Settings documents and sets."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import attach, keep_known


def _leaves(value: Any, path: tuple[str, ...] = ()) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict) and value:
        for key, inner in value.items():
            yield from _leaves(inner, (*path, key))
    else:
        yield (json.dumps(path, separators=(",", ":"), ensure_ascii=False),
               json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def flatten_json(docs: DataFrame, key: str = "doc", body: str = "json") -> DataFrame:
    """S1. Document to leaves ``(key, path, val)``; paths are JSON arrays, values canonical."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *leaf) for k, text in zip(pdf[key], pdf[body])
                    for leaf in _leaves(json.loads(text))]
            yield pd.DataFrame(rows, columns=[key, "path", "val"])

    return docs.select(F.col(key).cast("string").alias(key), body).mapInPandas(
        explode, f"{key} string, path string, val string")


def unflatten(leaves: DataFrame, key: str = "doc") -> DataFrame:
    """S2. Leaves to canonical JSON. A document is one cell, limited by the state cap."""
    listed = leaves.groupBy(key).agg(F.collect_list(F.struct("path", "val")).alias("_l"))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "json": [_rebuild(ls) for ls in pdf["_l"]]})

    return listed.mapInPandas(render, f"{key} string, json string")


def _rebuild(leaves: Any) -> str:
    root: Any = {}
    for leaf in leaves:
        path, value = json.loads(leaf["path"]), json.loads(leaf["val"])
        if not path:
            root = value
            continue
        at = root
        for step in path[:-1]:
            at = at.setdefault(step, {})
        at[path[-1]] = value
    return json.dumps(root, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def field_map_diff(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """S3. Writes that turn the present leaves of ``state`` into ``snapshot``.

    Both are ``(doc, path, val)``, state with ``present``. A deletion is a leaf with
    ``present`` false, which is not a JSON null.
    """
    held = state.where("present").select("doc", "path", F.col("val").alias("_old"),
                                         F.lit(True).alias("_held"))
    new = snapshot.select("doc", "path", F.col("val").alias("_new"), F.lit(True).alias("_has"))
    j = held.join(new, ["doc", "path"], "full_outer")
    changed = F.col("_has").isNotNull() & (
        F.col("_held").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")))
    gone = F.col("_has").isNull()
    return j.where(changed | gone).select(
        "doc", "path", F.col("_new").alias("val"), F.col("_has").isNotNull().alias("present"))


def _clock() -> Column:
    return F.struct("ms", "cnt", "node")


def field_map_state(leaves: DataFrame) -> DataFrame:
    """S4. Newest write per leaf, deletions included."""
    top = leaves.groupBy("doc", "path").agg(
        F.max(F.struct(_clock().alias("at"), "val", "present")).alias("t"))
    return top.select("doc", "path", "t.at.ms", "t.at.cnt", "t.at.node", "t.val", "t.present")


def field_map_merge(leaves: DataFrame) -> DataFrame:
    """S4. Present leaves after last-writer-wins per leaf."""
    return field_map_state(leaves).where("present").drop("present")


def orset_diff(members: DataFrame, snapshot: DataFrame) -> DataFrame:
    """S5. Adds and removes that turn the current members into the snapshot."""
    have = members.select("sid", "elem").distinct().withColumn("_m", F.lit(True))
    want = snapshot.select("sid", "elem").distinct().withColumn("_s", F.lit(True))
    j = have.join(want, ["sid", "elem"], "full_outer")
    op = F.when(F.col("_m").isNull(), "add").when(F.col("_s").isNull(), "remove")
    return j.select("sid", "elem", op.alias("op")).where("op is not null")


def orset_merge(adds: DataFrame, removed: DataFrame) -> DataFrame:
    """S6. Elements with an add dot no removal has observed."""
    return adds.join(removed.select("sid", "elem", "dot").distinct(), ["sid", "elem", "dot"],
                     "left_anti").select("sid", "elem").distinct()


def orset_render(adds: DataFrame, removed: DataFrame) -> DataFrame:
    """S7. Sorted member array per set as canonical JSON."""
    return orset_merge(adds, removed).groupBy("sid").agg(
        F.to_json(F.sort_array(F.collect_list("elem"))).alias("members"))


def whole_file_merge(versions: DataFrame, key: str = "doc") -> DataFrame:
    """S8. Newest content per resource."""
    return versions.groupBy(key).agg(
        F.max(F.struct(_clock().alias("at"), "content")).alias("t")).select(
        key, "t.at.ms", "t.at.cnt", "t.at.node", "t.content")


def whole_file_diff(state: DataFrame, snapshot: DataFrame, key: str = "doc") -> DataFrame:
    """S8. Snapshot rows to write: unknown resources or other content; equal writes nothing."""
    held = state.select(key, F.col("content").alias("_c"))
    return snapshot.join(held, key, "left").where(
        ~F.col("content").eqNullSafe(F.col("_c"))).drop("_c")


def orset_pull(adds: DataFrame, removed: DataFrame, pulled_adds: DataFrame,
               pulled_removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S9 for set resources. (members after the join, per touched set: changed).

    Dots join by union, so nothing but the member lists before and after is compared.
    """
    dots = ["sid", "elem", "dot"]
    touched = pulled_adds.select("sid").union(pulled_removed.select("sid")).distinct()
    before = orset_merge(adds, removed).withColumn("_a", F.lit(True))
    after = orset_merge(adds.select(*dots).union(pulled_adds.select(*dots)),
                        removed.select(*dots).union(pulled_removed.select(*dots)))
    delta = before.join(after.withColumn("_b", F.lit(True)), ["sid", "elem"], "full_outer").where(
        F.col("_a").isNull() | F.col("_b").isNull()).select("sid").distinct().withColumn(
        "_changed", F.lit(True))
    report = touched.join(delta, "sid", "left").select(
        "sid", F.coalesce("_changed", F.lit(False)).alias("changed"))
    return after, report


def settings_pull(local: DataFrame, remote: DataFrame, kind_of: Column,
                  tag: str = "settings") -> tuple[DataFrame, DataFrame]:
    """S9 / U3. Fold pulled leaf writes into the local ones (sets: ``orset_pull``).

    A whole-file resource is a single leaf with an empty path, so it folds the same way.

    ``local`` and ``remote``: ``(doc, path, val, present, ms, cnt, node)``; remote also
    ``(envelope, record_id)``. ``kind_of`` is a column over ``doc`` giving the merge kind,
    null for unknown or disabled resources. Rows of other envelopes are dropped. Returns
    (merged state, per resource: records, changed, needs_compaction).
    """
    ours = remote.where(F.col("envelope") == tag).withColumn("kind", kind_of).where(
        "kind is not null")
    cols = ["doc", "path", "val", "present", "ms", "cnt", "node"]
    touched = ours.groupBy("doc").agg(F.countDistinct("record_id").alias("records"))
    before = field_map_state(keep_known(local.select(*cols), touched, ["doc"]))
    after = field_map_state(before.select(*cols).unionByName(ours.select(*cols)))
    shown = lambda df, name: df.where("present").select("doc", "path", F.col("val").alias(name))
    delta = shown(before, "_a").join(shown(after, "_b"), ["doc", "path"], "full_outer").where(
        ~F.col("_a").eqNullSafe(F.col("_b"))).select("doc").distinct().withColumn(
        "_changed", F.lit(True))
    report = touched.join(delta, "doc", "left").select(
        "doc", "records", F.coalesce("_changed", F.lit(False)).alias("changed"),
        (F.col("records") > 1).alias("needs_compaction"))
    return after, report


def with_kind(rows: DataFrame, kinds: DataFrame, key: str = "doc") -> DataFrame:
    """U3. Attach a classifier given as a table instead of an expression."""
    return attach(rows, kinds, [key])
