"""Tables that a plan writes to the shared folder and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir. Where that is unset and everything runs on one
    machine, as in tests, a temporary folder takes its place; on a cluster that
    is an error, as executors could not read it.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage and survives lost executors. Returns the table and
    its path, for unstage(). What is not deleted before goes when the driver ends.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def forget_at_exit(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.deleteOnExit(folder)


def unstage(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that no later plan reads."""
    for path in paths:
        fs, folder = _folder(spark, path)
        fs.delete(folder, True)
