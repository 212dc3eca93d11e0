"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which a query removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Settings of every written step. Rows of blocks and of long texts are large, and a batch for Python is
#: held twice in the JVM while it grows and once more in Python, for each task.
SETTINGS = {CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Where it is unset, a session on one machine (tests) gets
    a folder of its own; on a cluster there is no such folder that all could see."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sunledger-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Named tables of one run under the shared folder.

    `keep` writes a plan once and reads it back, so that a lost executor never costs more than
    the current step. Tables that have served their purpose are dropped; the rest go when the
    driver ends.
    """

    def __init__(self, spark: SparkSession, kind: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/sunledger-{kind}-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes `df` and returns the written table. The shuffle files of the write go with it: what
        it read from stays as tables, so nothing needs them any more."""
        with self._settings():
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    @contextmanager
    def _settings(self) -> Iterator[None]:
        before = {k: self.spark.conf.get(k, None) for k in SETTINGS}
        for k, v in SETTINGS.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for name in names:
            self._fs.delete(self._path(self.path(name)), True)

    def drop_but(self, *names: str) -> None:
        """Deletes all tables but these."""
        for status in self._fs.listStatus(self._path(self.root)):
            if status.getPath().getName() not in names:
                self._fs.delete(status.getPath(), True)

    def release(self) -> None:
        """Lets Spark's cleaner remove what plans of others (a stage before) left behind."""
        gc.collect()
        self.spark._jvm.System.gc()
