"""URL filter: prefix rules, and a Bloom filter cascade for a list of hosts.

The cascade knows every key that can be asked (the hosts of the corpus). Level 0 holds the listed
keys, level 1 the other keys that level 0 takes for listed, level 2 the listed keys that level 1
takes for false, and so on until a level errs no more. The first level that does not hold a key tells
which kind it is: exact for all keys of the universe, with no join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: ``(verdict, host, path)``; fixed values of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A level's bits are collected and broadcast up to so many (16 MB); a longer list is joined instead.
LEVEL_BITS = 1 << 27
_FIRST_RATE, _NEXT_RATE = 0.01, 0.5


def host_of(url: Column) -> Column:
    rest = F.expr("substring(__url, instr(__url, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.expr("substring(__url, instr(__url, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``__host`` and ``__path``; both empty for a null url or one without ``://``."""
    u = F.coalesce(F.col("__url"), F.lit(""))
    return (pages.withColumn("__url", F.coalesce(F.col(url), F.lit("")))
            .withColumn("__host", host_of(u)).withColumn("__path", path_of(u)).drop("__url"))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> list[np.ndarray]:
    a = h1.astype(np.uint64) + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(32)
    a *= np.uint64(0xD6E8FEB86659FD93)
    b = h2.astype(np.uint64) | np.uint64(1)
    return [((a + np.uint64(i) * b) >> np.uint64(7)) % np.uint64(bits) for i in range(hashes)]


def _holds(words: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(places[0]) if places else 0, bool)
    for p in places:
        out &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))


def _fill(keys: DataFrame, n: int, level: int, rate: float) -> tuple[int, int, np.ndarray]:
    """A level over ``n`` keys: bits, hashes, and the bits in words of 64."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(bits / n * math.log(2)))

    def places(batches):
        for b in batches:
            p = np.concatenate(_places(b["h1"].to_numpy(), b["h2"].to_numpy(), level, bits, hashes))
            one = (np.uint64(1) << (p & np.uint64(63))).view(np.int64)
            yield pd.DataFrame({"word": (p >> np.uint64(6)).astype(np.int64), "bit": one})

    rows = (keys.select("h1", "h2").mapInPandas(places, "word long, bit long")
            .groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow())
    words = np.zeros(-(-bits // 64), np.uint64)
    words[rows["word"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return bits, hashes, words


def _first_without(levels):
    """The number of the first level that does not hold a key; the number of levels if all do."""

    @F.pandas_udf("int")
    def number(h1: pd.Series, h2: pd.Series) -> pd.Series:
        a, b = h1.to_numpy(), h2.to_numpy()
        out, live = np.full(len(a), len(levels.value)), np.arange(len(a))
        for i, (bits, hashes, words) in enumerate(levels.value):
            ok = _holds(words, _places(a[live], b[live], i, bits, hashes))
            out[live[~ok]] = i
            live = live[ok]
        return pd.Series(out)

    return number


class Cascade:
    """Exact membership among the keys of ``universe``, a table of distinct non-null ``key``."""

    def __init__(self, universe: DataFrame, listed: Column):
        self.sc = universe.sparkSession.sparkContext
        keys = stored(_hashed(universe).withColumn("listed", F.coalesce(listed, F.lit(False))), "keys")
        mine, other = keys.where("listed"), keys.where("not listed")
        self.levels, self.listed = [], None
        while True:
            level = len(self.levels)
            n = mine.count()
            if not n:
                break
            if n > LEVEL_BITS / 10:
                self.listed = keys.where("listed").select("key")
                break
            self.levels.append(_fill(mine, n, level, _NEXT_RATE if level else _FIRST_RATE))
            passed = _first_without(self.sc.broadcast(self.levels))("h1", "h2") == level + 1
            mine, other = stored(other.where(passed), "level"), mine

    def ask(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with ``name``: whether its ``key``, a key of the universe, is listed."""
        if self.listed is not None:
            listed = self.listed.select(F.col("key").alias(key), F.lit(True).alias(name))
            return df.join(listed, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
        if not self.levels:
            return df.withColumn(name, F.lit(False))
        number = _first_without(self.sc.broadcast(self.levels))
        # Even levels hold listed keys: one that all levels hold is of the last level's kind.
        at = number(F.xxhash64(key), F.xxhash64(key, F.lit(1)))
        return df.withColumn(name, at % 2 == 1)


#: A host is listed when one of its labels begins so.
LISTED = r"(^|[.-])spam"


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, listed: str = LISTED) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    The longest rule that fits decides; else hosts that match ``listed`` are blocked, by a cascade
    over all hosts of ``pages``. A url that is null or has no ``://`` has an empty host and path, fits no
    rule and is allowed.
    """
    rows = with_parts(pages.select(F.col(key).alias("page_id"), F.col(url).alias("__u")), "__u")
    hosts = rows.where("__host != ''").select(F.col("__host").alias("key")).distinct()
    cascade = Cascade(hosts, F.col("key").rlike(listed))
    name, verdict = rule_columns(F.col("__host"), F.col("__path"), rules)
    rows = cascade.ask(rows, "__host", "__listed").withColumn("__listed", F.col("__listed") & (F.col("__host") != ""))
    return rows.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), name.alias("rule"),
                       F.coalesce(verdict, F.when(F.col("__listed"), "block").otherwise("allow")).alias("verdict"))


def judge_sql() -> str:
    """The DuckDB twin of ``judge`` with its default rules and list."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
with r(verdict, rhost, rpath) as (values {rules}),
u as (select page_id, instr(coalesce(url, ''), '://') pos,
             substr(url, instr(url, '://') + 3) rest from pages),
p as (select row_number() over () n, page_id,
             case when pos > 0 then translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz') else '' end host,
             case when pos > 0 then regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) else '' end path from u),
f as (select n, rhost || rpath rule, verdict, row_number() over (partition by n order by length(rhost || rpath) desc) k
      from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, case when regexp_matches(host, '{LISTED}') then 'block' else 'allow' end)
       verdict
from p left join f on f.n = p.n and k = 1
"""
