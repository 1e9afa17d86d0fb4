"""Quality rules with host verdicts: document rules, host failure rates shrunk by a beta prior.

Built-in functions only. Every document rule is an expression over its own row, so the texts are
read once and never shuffle; what is aggregated is one narrow row per host and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

_GAP, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
_SYMBOLS = "#*$%&|<>"
_PLACE_BITS = 22  # a window's place, beside 42 bits of its hash, in one sortable number
_PLACE = (1 << _PLACE_BITS) - 1
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _p(name: str) -> str:
    return f"__rule_{name}"


def with_measures(docs: DataFrame, text: str = "text", repeat_width: int = 3) -> DataFrame:
    """``docs`` with the five measures, as ``__rule_<measure>`` columns.

    Repeated windows: window hashes are packed with their places and sorted, so equal windows stand
    side by side, and only those are looked at again, word by word. A text in which two different
    windows share a hash, or with over four million words, sorts its windows as texts instead.
    """
    k = repeat_width
    w, n, packed, same, text_of = (_p(x) for x in ("w", "n_words", "packed", "same", "text"))

    def word(i):
        return F.get(F.col(w), i)

    def gram_equal(i, j):
        out = F.lit(True)
        for d in range(k):
            out = out & (word(i + d) == word(j + d))
        return out

    def place(x):
        return x.bitwiseAND(F.lit(_PLACE)).cast("int")

    def head(x):
        return F.shiftright(x, _PLACE_BITS)

    df = docs.withColumn(text_of, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(w, F.array_remove(F.split(text_of, _GAP), ""))
    df = df.withColumn(n, F.size(w))
    places = F.sequence(F.lit(0), F.col(n) - k)
    some = (F.col(n) > k) & (F.col(n) <= _PLACE)
    none = F.array().cast("array<bigint>")
    df = df.withColumn(packed, F.when(some, F.sort_array(F.transform(places, lambda i: F.xxhash64(
        *[word(i + d) for d in range(k)]).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))))).otherwise(none))
    at = F.col(packed)
    df = df.withColumn(same, F.filter(at, lambda x, i: (head(x) == head(F.get(at, i - 1)))
                                      | (head(x) == head(F.get(at, i + 1)))))
    kept = F.col(same)
    clash = F.exists(F.sequence(F.lit(1), F.size(kept) - 1), lambda i: (
        head(F.get(kept, i)) == head(F.get(kept, i - 1))) & ~gram_equal(
        place(F.get(kept, i)), place(F.get(kept, i - 1))))
    by_hash = F.sort_array(F.transform(kept, place))
    grams = F.sort_array(F.transform(places, lambda i: F.struct(
        F.concat_ws(" ", *[word(i + d) for d in range(k)]).alias("g"), i.alias("i"))))
    df = df.withColumn(_p("slow"), (F.col(n) > _PLACE) | F.when(F.size(kept) > 1, clash).otherwise(False))
    df = df.withColumn(_p("grams"), F.when(F.col(_p("slow")), grams))
    g = F.col(_p("grams"))
    by_text = F.sort_array(F.transform(F.filter(g, lambda x, i: F.coalesce(
        (x["g"] == F.get(g, i - 1)["g"]) | (x["g"] == F.get(g, i + 1)["g"]), F.lit(False))), lambda x: x["i"]))
    df = df.withColumn(_p("at"), F.when(F.col(_p("slow")), by_text).otherwise(by_hash))
    hit = F.col(_p("at"))
    covered = F.aggregate(F.transform(hit, lambda x, i: F.least(F.lit(k), F.coalesce(
        F.get(hit, i + 1) - x, F.lit(k)))), F.lit(0), lambda a, x: a + x)
    source = F.col(text_of)
    symbols = F.lit(0)
    for c in _SYMBOLS:
        symbols = symbols + F.octet_length(source) - F.octet_length(F.replace(source, F.lit(c)))
    lines = F.filter(F.split(source, "\n"), lambda x: x.rlike(_WORD))
    df = df.withColumn(_p("lines"), F.when(F.instr(source, "\n") > 0, lines).otherwise(
        F.array().cast("array<string>")))
    found = {"n_words": F.col(n), "word_chars": F.length(F.concat_ws("", w)), "n_symbols": symbols,
             "n_dup_lines": F.size(_p("lines")) - F.size(F.array_distinct(_p("lines"))),
             "n_repeat_words": F.when(F.size(hit) > 0, covered).otherwise(0)}
    return df.select(*docs.columns, *[found[m].cast("long").alias(_p(m)) for m in MEASURES])


def _failed(least_words: int, repeat_percent: int):
    n, r = F.col(_p("n_words")), F.col(_p("n_repeat_words"))
    return (n < least_words) | (100 * r > repeat_percent * n)


def rejected_hosts(judged: DataFrame, max_rate: float = 0.9) -> DataFrame:
    """Hosts whose shrunken failure rate is above ``max_rate``; ``judged`` is ``(host, failed)``.

    The beta prior is fitted by moments to the rates of all hosts, each weighted by its documents:
    its strength is ``m (1 - m) / v - 1``, held between 1 and a million. A null host has no verdict.
    """
    hosts = judged.where("host is not null").groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    hosts = stored(hosts, "hosts")
    rate = F.col("f") / F.col("n")
    one = hosts.agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum(rate * rate * F.col("n")).alias("s")).first()
    if not one.n:
        return hosts.select("host").limit(0)
    mean = one.f / one.n
    spread = max(one.s / one.n - mean * mean, 0.0)
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    return hosts.where((F.col("f") + mean * strength) / (F.col("n") + strength) > max_rate).select("host")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least_words: int = 50,
          repeat_percent: int = 50, max_rate: float = 0.9) -> DataFrame:
    """Measures and verdicts, one row per row of ``docs``.

    A document fails by itself with under ``least_words`` words, or when more than
    ``repeat_percent`` of its words lie in repeated windows; it is also not kept when its host is
    rejected. Null and empty texts have no words and fail. Rows that share an id are judged apart.
    """
    rows = with_measures(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"),
                                     F.col(host).alias("host")))
    rows = stored(rows.select("doc_id", "host", *[F.col(_p(m)) for m in MEASURES],
                              _failed(least_words, repeat_percent).alias("failed")), "measures")
    bad = rejected_hosts(rows.select("host", "failed"), max_rate).withColumn("bad", F.lit(True))
    return rows.join(bad, "host", "left").select(
        "doc_id", *[F.col(_p(m)).alias(m) for m in MEASURES], F.col("failed").alias("base_failed"),
        (~F.col("failed") & F.col("bad").isNull()).alias("kept"))


def keep(docs: DataFrame, text: str = "text", host: str = "source", least_words: int = 50,
         repeat_percent: int = 50, max_rate: float = 0.9) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, columns as they are.

    The rows are written once with their verdict: a filter on a computed verdict would be pushed
    into the array functions and evaluate them again for every element.
    """
    rows = stored(with_measures(docs, text).withColumn(_p("failed"), _failed(least_words, repeat_percent))
                  .select(*docs.columns, _p("failed")), "judged")
    bad = rejected_hosts(rows.select(F.col(host).alias("host"), F.col(_p("failed")).alias("failed")), max_rate)
    bad = bad.withColumnRenamed("host", _p("host"))
    return (rows.where(~F.col(_p("failed"))).select(*docs.columns)
            .join(bad, F.col(host) == F.col(_p("host")), "left_anti"))


JUDGE_SQL = r"""
with t as (select row_number() over () r, doc_id, source host, coalesce(text, '') s,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
e as (select r, unnest(w) x, unnest(range(1, len(w) + 1)) i from t),
g as (select r, i, x || ' ' || lead(x) over o || ' ' || lead(x, 2) over o g from e
      window o as (partition by r order by i)),
d as (select r, i from (select r, i, count(*) over (partition by r, g) c from g where g is not null) where c > 1),
c as (select r, count(distinct i + k) n from d, (values (0), (1), (2)) v(k) group by r),
l as (select r, count(*) - count(distinct x) n from (select r, unnest(string_split(s, chr(10))) x from t)
      where regexp_matches(x, '[^\x20\x09-\x0D]') group by r),
m as (select t.r, doc_id, host, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
             length(regexp_replace(s, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
             coalesce(l.n, 0)::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words
      from t left join c on c.r = t.r left join l on l.r = t.r),
j as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m),
h as (select host, count(*) n, sum(base_failed::int) f from j where host is not null group by host),
p as (select sum(f) / sum(n) mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2 v from h),
q as (select mean, case when v > 0 then least(greatest(mean * (1 - mean) / v - 1, 1), 1e6) else 1e6 end k from p),
b as (select host from h, q where (f + mean * k) / (n + k) > 0.9)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and b.host is null kept
from j left join b on b.host = j.host
"""
