"""Session builder and the checkpoint folder lookup."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Merge session windows before the shuffle, so that a busy path does not travel row by row.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build(master: str | None = None, partitions: int | None = None, app: str = "tidemark",
          **extra: str) -> SparkSession:
    """A session with the settings the operators assume.

    On a cluster leave ``master`` and ``partitions`` unset: the submit command names the
    master, and AQE coalesces from the cluster's own shuffle width.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    # Folders of checkpoints nothing refers to any more are removed.
    core = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in {**SETTINGS, **core, **extra}.items():
        b = b.config(key, value)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; invent one only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: "
                           "iterative operators cut their lineage there")


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.

    For a frame that several later steps of one job read: without the cut each of them
    would carry, and plan, the whole history of the frame.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def hadoop_path(spark: SparkSession, folder: str):
    """The file system a folder lies on, and its path there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
