"""Where steps that are read more than once are kept: the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def stage(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept, so that a lost executor costs no earlier step."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of landed content that a task parses, on average.
ROWS_A_TASK = 10_000


def spread(df: DataFrame, key: str | list[str], rows: int = ROWS_A_TASK) -> DataFrame:
    """`df` dealt by a key that few rows share over as many tasks as its rows need, whatever files they lay in: content that takes
    long to parse may lie in one small file. Windows by this key, whatever else they are by, need no other shuffle. Rows
    are counted first."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *([key] if isinstance(key, str) else key))


def run_folder(spark: SparkSession, kind: str) -> str:
    """A new folder of one run under the shared one; it goes when the driver ends."""
    folder = f"{shared_folder(spark)}/sunledger-{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder
