"""Written tables between the steps of an iterative operator: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Staging:
    """Parquet tables in the cluster's shared folder (``spark.checkpoint.dir``) for one call of an operator.

    Only a local session without that setting gets a temporary folder. As a context
    manager it deletes all its tables but those handed to ``keep``, after failures too.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self._made: dict[str, bool] = {}
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            sc = spark.sparkContext
            if not sc._jsc.sc().getCheckpointDir().isDefined():
                if not sc.master.startswith("local"):
                    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
                sc.setCheckpointDir(tempfile.mkdtemp(prefix="sigloom-"))
            top = sc._jsc.sc().getCheckpointDir().get()
        self.root = f"{top.rstrip('/')}/sigloom-{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path, kept in self._made.items():
            if not kept:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)

    def table(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """``df`` written and read again. What a returned frame still reads must be kept."""
        path = f"{self.root}/{len(self._made)}"
        self._made[path] = keep
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        return self.table(df, keep=True)
