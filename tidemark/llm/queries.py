"""The registered queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, forest, licenses, negatives, ngram_join, packing, pages, repeats, repair, rules, seeds, url_filter, warc
from .common import table

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

REPEATS_SQL = rf"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
e as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) i from d),
g as (select doc_id, i, x, string_agg(x, ' ') over o g, count(*) over o n from e
      window o as (partition by doc_id order by i rows between current row and 19 following)),
f as (select doc_id, i, x, n = 20 and row_number() over (partition by n, g order by doc_id, i) > 1 again from g),
c as (select doc_id, i, x, max(again) over (partition by doc_id order by i rows between 19 preceding and current row) gone
      from f),
r as (select doc_id, count(*) n_words, count(*) filter (where gone) n_removed,
             string_agg(x, ' ' order by i) filter (where not gone) kept from c group by doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed,
       sha256(coalesce(kept, '')) kept_sha256 from d left join r on r.doc_id = d.doc_id
"""

SIMILAR_SQL = rf"""
with recursive d as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w
      from documents),
e as (select doc_id, len(w) size, unnest(w) x, unnest(range(1, len(w) + 1)) i from d),
g as (select doc_id, size, i, string_agg(x, ' ') over o g, count(*) over o n from e
      window o as (partition by doc_id order by i rows between current row and 4 following)),
s as (select distinct doc_id, g from g where n = 5 or size < 5 and i = 1),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
k as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
l as (select a, b from k union all select b, a from k),
r(doc_id, x) as (select doc_id, doc_id from d union select r.doc_id, l.b from r join l on l.a = r.x)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(r.x) component_id
from d join r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""

FOREST_SQL = f"select *, doc_id = component_id kept from ({SIMILAR_SQL.replace('>= 80 *', '>= 85 *')})"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def op1_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return packing.round_trip(_documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(_documents(spark, folder), with_text=False)


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_documents(_documents(spark, folder))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(_documents(spark, folder))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_documents(spark, folder))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return seeds.overlaps(_documents(spark, folder), table(spark, folder, "benchmark"))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(_documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mine(negatives.labelled(table(spark, folder, "embeddings")))


def op12_minhash_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.near_duplicates(_documents(spark, folder))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, folder, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_ids, op2_substring_dedup, op3_main_text, op4_ngram_join, op5_quality_rules,
                            op6_warc, op7_url_filter, op8_license_scan, op9_decontamination, op10_bpe,
                            op11_hard_negatives, op12_minhash_forest,
                            op13_conversation_repair)}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": REPEATS_SQL, "op4_ngram_join": SIMILAR_SQL, "op5_quality_rules": rules.JUDGE_SQL,
    "op6_warc": warc.ROUND_TRIP_SQL, "op7_url_filter": url_filter.judge_sql(),
    "op8_license_scan": licenses.scan_sql(), "op11_hard_negatives": negatives.MINE_SQL,
    "op12_minhash_forest": FOREST_SQL,
    "op13_conversation_repair": repair.repair_sql()}
