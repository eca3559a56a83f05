"""Intermediate tables in the folder that driver and executors share.

A cluster names that folder in ``spark.checkpoint.dir``.  Tables are written with Spark's own writers and read again,
which cuts the lineage and survives the loss of executors.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import shared_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of an Arrow batch: whole texts can be long, and a batch is held several times on its way through a task.
BATCH_BYTES = 4 << 20


def importable(spark: SparkSession) -> None:
    """Let Python workers of this session import the package from where the driver found it, and keep batches small."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(size, BATCH_BYTES)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def quoted(name: str) -> Column:
    """The column of that very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


class Scratch:
    """A new folder below the shared one; ``keep`` writes a table there and returns it as read back.

    The folder goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str, base: str | None = None):
        importable(spark)
        self.spark = spark
        self.path = f"{base or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: dict[int, str] = {}

    def _file_system(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def new(self, name: str) -> str:
        """The path of a table that does not exist yet."""
        if not self._n:
            fs, folder = self._file_system(self.path)
            fs.mkdirs(folder)
            fs.deleteOnExit(folder)
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.new(name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._tables[id(kept)] = path
        return kept

    def drop(self, df: DataFrame) -> None:
        """Remove the files of a table made by ``keep`` that nothing reads any more."""
        if path := self._tables.pop(id(df), None):
            fs, folder = self._file_system(path)
            fs.delete(folder, True)
