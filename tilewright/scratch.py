"""Temporary tables in the folder that all executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or our own in local mode where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path for a temporary table in the shared folder."""
    return f"{shared_folder(spark)}/tilewright/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    at = path(spark, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._scratch_path = at
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` returned; only what has been written itself may have been made from them."""
    for df in tables:
        where = getattr(df, "_scratch_path", None)
        if where:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
