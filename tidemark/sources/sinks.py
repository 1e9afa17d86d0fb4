"""Register upserts (A7) and vault exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blobs import reassemble
from ..operators.causal import FILE, current_values
from ..plans.skew import attach, drop_known
from ..session import ensure_checkpoint_dir, settle


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint area, for tables between two steps."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def write_registers(current: DataFrame, updates: DataFrame, touched: DataFrame, path: str,
                    buckets: int = 64) -> None:
    """A7. Next version of the register table: files in ``touched`` are replaced.

    A touched file without a row in ``updates`` is an empty register, so it disappears. The
    table is laid out by a hash of the file key, and written to a new folder so that a
    failed job leaves the current version whole.
    """
    kept = drop_known(current, touched, FILE)
    bucket = F.pmod(F.xxhash64(*FILE), F.lit(buckets)).cast("int")
    (kept.unionByName(updates.select(*current.columns)).withColumn("bucket", bucket)
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def export_rows(records: DataFrame, manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """A8. Every value with its export outcome and, when exported, its bytes.

    Only live, unconflicted files are read back. Reassembly is keyed by manifest, once per
    distinct manifest, however many files share it.
    """
    sized = settle(current_values(records))
    wanted = sized.where("n_values = 1 and not tombstone").select(
        F.col("blob_ref").alias("manifest")).distinct()
    content = settle(reassemble(manifests.join(wanted, "manifest", "left_semi"), chunks))
    joined = attach(sized.withColumnRenamed("blob_ref", "manifest"),
                    content.select("manifest", "content"), ["manifest"])
    status = (F.when(F.col("n_values") > 1, "conflict").when(F.col("tombstone"), "tombstone")
              .when(F.col("content").isNull(), "unavailable").otherwise("exported"))
    return joined.withColumn("status", status).withColumn(
        "content", F.when(F.col("status") == "exported", F.col("content")))


def export_vaults(rows: DataFrame, path: str) -> None:
    """A8. Write the exported ones of ``export_rows``, one folder per vault."""
    (rows.where("status = 'exported'").select("vault_id", "path", "content")
     .write.mode("overwrite").partitionBy("vault_id").parquet(path))


def export_report(rows: DataFrame) -> DataFrame:
    """A8. Exported files and bytes, skipped tombstones and conflicted files, unavailable."""
    per_file = rows.groupBy(*FILE).agg(F.max("status").alias("status"),
                                       F.max(F.octet_length("content")).alias("bytes"))
    return per_file.groupBy("vault_id").agg(
        F.count_if(F.col("status") == "exported").alias("exported"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"),
        F.count_if(F.col("status") == "tombstone").alias("skipped_tombstones"),
        F.count_if(F.col("status") == "conflict").alias("skipped_conflicts"),
        F.count_if(F.col("status") == "unavailable").alias("unavailable"))


def write_records(records: DataFrame, path: str, files: int = 200) -> None:
    """A9. Records laid out for the two reads that matter: one keyspace (partition pruning)
    and everything after a cursor (row-group statistics of the sorted sequence).

    Range partitioning splits a vault that holds a large share of the rows over as many
    files as its share deserves.
    """
    (records.repartitionByRange(files, "vault_id", "ns", "server_seq")
     .sortWithinPartitions("vault_id", "ns", "server_seq")
     .write.mode("overwrite").partitionBy("vault_id", "ns").parquet(path))
