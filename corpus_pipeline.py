"""A training corpus out of `documents`: rules, near duplicates, repeated passages, test items, tokens.

Each stage takes what the one before it kept. All but the last return the columns of documents. A
stage begins when the one before it is written, so it first removes that one's work folders.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, ngram_join, repeats, rules, seeds
from tidemark.llm.common import release, scratch, table, work_folders


_LAST: list[str] = []


def _stage(f):
    """Remove the work folders of the stage before, and note those of this one."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _LAST)
        before = work_folders()
        out = f(spark, docs, sf_dir)
        _LAST[:] = work_folders() - before
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host is not rejected."""
    return rules.keep(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of linked documents.

    Of rows that share an id one stays; rows without an id are in no group and stay.
    """
    groups = ngram_join.similar_documents(docs)
    heads = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__head"))
    kept = docs.join(heads, F.col("doc_id") == F.col("__head"), "left_semi")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that stand earlier; ``n_chars`` follows the text."""
    kept = repeats.remove_repeats(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return kept


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return seeds.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the kept texts."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("n-gram join", near_duplicates), ("substring dedup", substring_dedup),
          ("decontamination", benchmark_decontamination), ("bpe", bpe_tokens)]
#: BPE has no SQL form; `tests/llm` holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        folder = scratch(spark, "stage", work=False)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
