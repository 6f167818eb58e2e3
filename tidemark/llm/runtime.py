"""What the operators share: written intermediate tables, paths, partition counts."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidemark.package import ship as prepare  # noqa: F401

_CLEANUP = ("spark.sql.shuffleDependency.fileCleanup.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one is made only where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


class Workspace:
    """A folder of written tables under the shared folder, removed when Python exits.

    A written table cuts the lineage and survives the loss of any executor.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a frame and read it; the shuffle files of the write go when it is done."""
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = {key: conf.get(key, "false") for key in _CLEANUP}
        for key in _CLEANUP:
            conf.set(key, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for key, value in before.items():
                conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them."""
        try:
            jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(hadoop).delete(path, True)
        except Exception:  # the session may have ended before Python does
            pass


def settle(spark: SparkSession) -> None:
    """Let Spark find and delete the files of shuffles that nothing refers to any longer."""
    gc.collect()
    spark._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a frame's bytes, from file sizes; 0 where it knows none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def partitions(spark: SparkSession, n_bytes: int, each: int = 64 << 20) -> int:
    """Partitions for a shuffle of n_bytes: spark.sql.shuffle.partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))


def shard_labels(n: int) -> np.ndarray:
    """n numbers of which Spark's hash partitioning into n puts one into each partition."""
    u = np.uint32

    def turned(x, r):
        return (x << u(r)) | (x >> u(32 - r))

    labels = np.arange(32 * n + 256, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(labels), 42, u)
        for half in (labels.astype(u), (labels >> np.uint64(32)).astype(u)):
            h ^= turned(half * u(0xCC9E2D51), 15) * u(0x1B873593)
            h = turned(h, 13) * u(5) + u(0xE6546B64)
        h ^= u(8)
        h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
        h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
        h ^= h >> u(16)
    at = h.view(np.int32).astype(np.int64) % n
    found, first = np.unique(at, return_index=True)
    out = labels[: n].astype(np.int64)  # a partition without a label shares one
    out[found] = first
    return out
