"""Put streams: registers, history and notifications.

Registers are a keyed table (`sources.keyed`), history and messages logs of per-batch folders. A batch that runs
again leaves the table as it is and overwrites its own folder, so a lost executor or driver repeats work without
repeating rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.causal import FILE, HLC, frontier, register_join
from ..plans.ordered import first_per_key
from ..plans.skew import attach
from ..session import hadoop_path, settle
from ..sources.keyed import KeyedTable


def _context_rows(puts: DataFrame) -> DataFrame:
    return puts.select(*FILE, F.explode("context").alias("node", "h"))


def _load(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None if nothing is there; a damaged folder fails."""
    system, place = hadoop_path(spark, path)
    return spark.read.parquet(path) if system.exists(place) else None


def _register_table(spark: SparkSession, folder: str, puts: StructType | None, buckets: int) -> KeyedTable:
    """Values (``_kind`` w) and frontiers (``_kind`` f) of a file in one bucket, so that one version holds both.

    The schema of the first puts is kept beside the table; later readers take it from there.
    """
    place = f"{folder}/schema.json"
    system, path = hadoop_path(spark, place)
    if puts is not None and not system.exists(path):
        seen = StructField("h", StructType([StructField("ms", LongType()), StructField("cnt", LongType())]))
        held = StructType([f for f in puts.fields if f.name != "context"] + [StructField("_kind", StringType()), seen])
        out = system.create(path, True)
        out.write(bytearray(held.json().encode()))
        out.close()
    stream = system.open(path)
    held = StructType.fromJson(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    stream.close()
    return KeyedTable(spark, f"{folder}/table", held, FILE, buckets)


def _register_rows(writes: DataFrame, ctx: DataFrame, schema: StructType) -> DataFrame:
    """What is left alive of the writes, and the frontier, as rows of the table."""
    alive = register_join(writes, ctx).withColumn("_kind", F.lit("w"))
    seen = frontier(ctx).withColumnRenamed("seen", "h").withColumn("_kind", F.lit("f"))
    both = alive.unionByName(seen, allowMissingColumns=True)
    return both.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _joined(rows: DataFrame) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("_kind", "h")]
    return _register_rows(rows.where("_kind = 'w'").select(*columns),
                          rows.where("_kind = 'f'").select(*FILE, "node", "h"), rows.schema)


def stream_registers(folder: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """E5. ``foreachBatch`` body: join each batch into the register table of ``folder``.

    ``puts``: write rows with a ``context`` map. Only the buckets that a batch touches are read and written; the new
    version appears at once, and a batch that runs again changes nothing. The register join may be applied in any
    grouping, so the table holds what a join over all puts would leave.
    """

    def apply(puts: DataFrame, batch: int) -> None:
        table = _register_table(puts.sparkSession, folder, puts.schema, buckets)
        fresh = settle(_register_rows(puts.drop("context"), _context_rows(puts), table.schema))
        table.update(fresh, lambda old, new: _joined(old.unionByName(new)), batch)

    return apply


def read_stream_registers(spark: SparkSession, folder: str) -> DataFrame:
    """E5. Current registers: the values of the table's newest version."""
    return _register_table(spark, folder, None, 1).read().where("_kind = 'w'").drop("_kind", "h")


def compact_registers(spark: SparkSession, folder: str, buckets: int | None = None) -> None:
    """E5. Write the table anew, in another number of buckets if given, while the stream and its readers go on."""
    _register_table(spark, folder, None, 1).rebuild(buckets, _joined)


def stream_history(folder: str) -> Callable[[DataFrame, int], None]:
    """E6. ``foreachBatch`` body: append one event per new value, with its operation."""

    def apply(puts: DataFrame, batch: int) -> None:
        spark = puts.sparkSession
        fresh = first_per_key(puts.drop("context"), [*FILE, *HLC], ["server_seq"])
        first = fresh.groupBy(*FILE).agg(F.min("server_seq").alias("_first"))
        past = _load(spark, folder)
        if past is not None:
            past = past.where(F.col("batch") < batch)
            fresh = fresh.join(past.select(*FILE, *HLC), [*FILE, *HLC], "left_anti")
            first = first.join(past.select(*FILE).distinct(), FILE, "left_anti")
        op = (F.when(F.col("tombstone"), "delete")
              .when(F.col("server_seq") == F.col("_first"), "create").otherwise("modify"))
        attach(fresh, first, FILE).withColumn("op", op).drop("_first").write.mode(
            "overwrite").parquet(f"{folder}/batch={batch}")

    return apply


def notifications(puts: DataFrame) -> DataFrame:
    """E7. One message per keyspace of a batch: topic, newest cursor, item count, sender."""
    return puts.groupBy("vault_id").agg(
        F.max("server_seq").alias("cursor"), F.count(F.lit(1)).alias("items"),
        F.max_by("node", "server_seq").alias("source")).select(
        F.concat(F.lit("states-changed:"), "vault_id").alias("topic"), "cursor", "items", "source")


def stream_notifications(folder: str) -> Callable[[DataFrame, int], None]:
    """E7. ``foreachBatch`` body writing the messages of each batch."""

    def apply(puts: DataFrame, batch: int) -> None:
        notifications(puts).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return apply


def run_available(stream: DataFrame, body: Callable[[DataFrame, int], None],
                  checkpoint: str) -> None:
    """Drain what a source holds now through a ``foreachBatch`` body."""
    query = (stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
