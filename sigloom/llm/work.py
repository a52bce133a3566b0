"""Shared folder handling: written tables cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sigloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


class Workspace:
    """Tables written for one call of an operator, dropped once they are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{work_dir(spark)}/sigloom-{name}-{uuid.uuid4().hex}"
        self._n = 0

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it again, with its lineage cut."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sigloom_path = path
        return out

    def drop(self, *tables: DataFrame, sweep: bool = True) -> None:
        """Delete written tables, and shuffle files that nothing refers to any more (small ones can wait)."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._sigloom_path)
            p.getFileSystem(conf).delete(p, True)
        if sweep:
            self.sweep()

    def sweep(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps.

        It works in the background, and what refers to a shuffle goes in one
        collection, the shuffle in the next.
        """
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.4)
