"""Results that are kept: written once to the shared folder, and read from there."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one is made only where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-written-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """A path of Spark's own file systems, and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def keep(df: DataFrame, name: str) -> DataFrame:
    """The frame's rows as they are now: made once, whatever is done with them, and whatever executor is lost.

    The table goes when Python exits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def drop():
        try:
            at, system = hadoop(spark, path)
            system.delete(at, True)
        except Exception:  # the session may have ended before Python does
            pass

    atexit.register(drop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
