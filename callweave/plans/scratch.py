"""Where jobs keep intermediate tables: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Folders of local sessions without the setting, and the paths that each application wrote.
_local: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor shares.

    Where it is unset, a local session gets one temporary folder; on a cluster that is an
    error, as executors would not share it.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        folder = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _local[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    The plan is cut there, the rows outlive their executors, and the size of the table is
    known to the optimiser from then on.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files(spark: SparkSession, path: str):
    """The Hadoop file system that holds a path, and the path for it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def clean(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application, once its results are taken; returns how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        fs, at = files(spark, path)
        fs.delete(at, True)
    return len(paths)
