"""Written intermediate tables.

A long plan is cut by writing a table into the folder that the cluster names in
``spark.checkpoint.dir`` and reading it back: every executor can reach it, so a lost executor
costs a re-read and not a recomputation, and the reread table has a known size, which lets
Spark choose broadcast joins and split skewed partitions by itself. What an operator no longer
needs it deletes; the rest, which its lazy result still reads, goes when the session ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Narrow rows in a file, where their number is known.
FILE_ROWS = 250_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Lets Spark delete the shuffle files of a finished write at once; a written table needs none.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_BYTES, _BYTES_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Bytes of an Arrow batch: long texts make batches of fewer rows.
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to BATCH_BYTES, unless it has a setting of its own.

    A lazy result is computed after its operator returned, so the bound stays. Two workers and the JVM
    hold several copies of a batch each; at Spark's 64 MB they take more than a small executor has.
    """
    if spark.conf.get(_BYTES) == _BYTES_DEFAULT:
        spark.conf.set(_BYTES, BATCH_BYTES)


def base_folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where the setting is absent and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="groundwell-")
    spark.sparkContext.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables of one operator run, each in a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{base_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        path = self._path(self.root)
        self._system(path).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _system(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def settle(self, df: DataFrame, batch_rows: int | None = None, rows: int | None = None) -> DataFrame:
        """Write ``df`` and return the reread table. Its schema is kept, also without rows.

        batch_rows: rows of an Arrow batch meanwhile; lower for wide rows, to bound a worker's memory.
        rows: a bound of the result's narrow rows, where it is known; it sets the number of files.
        """
        if rows is not None:
            df = df.coalesce(-(-rows // FILE_ROWS) or 1)
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        before = {name: self.spark.conf.get(name) for name in (_BATCH, _CLEAN)}
        self.spark.conf.set(_CLEAN, "true")
        if batch_rows:
            self.spark.conf.set(_BATCH, str(batch_rows))
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for name, value in before.items():
                self.spark.conf.set(name, value)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            path = self._path(table._scratch_path)
            self._system(path).delete(path, True)
