"""A live table keyed by hash buckets: updates rewrite the buckets they touch, readers stay on their version.

``data/<id>/bucket=<b>`` holds the rows of a bucket as one writer left them; nothing there is ever changed. A version
is a small file ``versions/<n>.json`` that names the folder of every bucket, the number of buckets, and the last
batch that went in. It is created exclusively, so of two writers that start from one version one wins and the other
begins again from the winner's: a compaction may run while a stream writes. A reader takes the newest version and keeps
to its folders. A batch that runs again finds its number in the version and does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """Rows of ``schema``, dealt to buckets by a hash of ``keys``; null keys are keys."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder, schema, list(keys), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> dict:
        """The newest version; an empty table is version 0. A file that is still being written does not count."""
        place = self._path(f"{self.folder}/versions")
        names = sorted((f.getPath().getName() for f in self._fs.listStatus(place)), reverse=True) if self._fs.exists(
            place) else []
        for name in names:
            text = self._text(self._path(f"{self.folder}/versions/{name}"))
            if text.endswith("\n"):
                return json.loads(text)
        return {"version": 0, "batch": -1, "buckets": self.buckets, "folders": {}}

    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, version: dict) -> bool:
        """Make ``version`` the newest, unless another writer has taken its number."""
        path = self._path(f"{self.folder}/versions/{version['version']:020d}.json")
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray((json.dumps(version) + "\n").encode()))
        out.close()
        return True

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def read(self, version: dict | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of a version (the newest by default), or of some of its buckets only."""
        version = self.version() if version is None else version
        wanted = [b for b in version["folders"] if buckets is None or int(b) in set(buckets)]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(
            *[f"{self.folder}/data/{version['folders'][b]}/bucket={b}" for b in wanted])

    def _write(self, rows: DataFrame, n: int) -> tuple[str, list[str]]:
        """A new data folder and the buckets it holds."""
        name = uuid.uuid4().hex
        place = f"{self.folder}/data/{name}"
        (rows.select(*self.schema.names).withColumn("bucket", self._bucket(n)).repartition(n, "bucket")
         .write.partitionBy("bucket").parquet(place))
        there = [f.getPath().getName() for f in self._fs.listStatus(self._path(place))]
        return name, [x.removeprefix("bucket=") for x in there if x.startswith("bucket=")]

    def update(self, rows: DataFrame, merge: Merge, batch: int | None = None) -> dict:
        """``merge(old, new)`` of the touched buckets becomes their content; returns the version made or found.

        ``merge`` gets the rows of the touched buckets and the new rows, and must keep to their keys. A ``batch`` at or
        below the table's last one is left out.
        """
        while True:
            now = self.version()
            if batch is not None and batch <= now["batch"]:
                return now
            n = now["buckets"]
            touched = [r[0] for r in rows.select(self._bucket(n).alias("b")).distinct().collect()]  # at most n
            made = {**now, "version": now["version"] + 1, "batch": now["batch"] if batch is None else batch}
            if touched:
                name, there = self._write(merge(self.read(now, touched), rows), n)
                made["folders"] = {b: f for b, f in now["folders"].items() if int(b) not in touched} | dict.fromkeys(
                    there, name)
            if self._commit(made):
                return made

    def rebuild(self, buckets: int | None = None, compact: Callable[[DataFrame], DataFrame] | None = None) -> dict:
        """Write all rows anew, in another number of buckets or after ``compact``, while others write and read."""
        while True:
            now = self.version()
            n = buckets or now["buckets"]
            rows = self.read(now)
            name, there = self._write(rows if compact is None else compact(rows), n)
            made = {**now, "version": now["version"] + 1, "buckets": n, "folders": dict.fromkeys(there, name)}
            if self._commit(made):
                return made
