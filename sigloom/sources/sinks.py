"""Writers: label text, JSON lines, comma-separated reports, and folders that appear whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_line(class_id: Column, start: Column, end: Column, n: Column, digits: int = 10) -> Column:
    """``class center width`` of an interval, as shares of the trace."""
    return F.format_string(f"%d %.{digits}f %.{digits}f", class_id, (start + end) / 2.0 / n, (end - start) / n)


def label_files(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The text of each file's labels in order of start; empty for keys whose class is null."""
    line = F.struct("start", "end", F.when(F.col("class_id").isNotNull(), label_line(F.col("class_id"), F.col("start"), F.col("end"), F.lit(n))).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return df.groupBy(*key).agg(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("text"))


def sorted_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON line, its fields in order of their names."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("value"))


def report(df: DataFrame, path: str, order: list[str]) -> None:
    """A small report as one file with a header, also where it has no rows."""
    df.orderBy(*order).coalesce(1).write.mode("error").option("header", True).csv(path)


def tree_digest(df: DataFrame, path: str, digest: str) -> DataFrame:
    """One digest of an inventory: of its sorted path-tab-digest lines."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", path, digest))), "\n")
    return df.agg(F.sha2(lines, 256).alias("digest"), F.count(F.lit(1)).alias("files"))


def publish(df: DataFrame, path: str, audits: list[tuple[str, Callable[[DataFrame], DataFrame]]] = ()) -> None:
    """Write beside ``path``, audit what was written, then rename; an existing path or a failed audit leaves nothing.

    An audit is a query that must return no rows.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    place = jvm.org.apache.hadoop.fs.Path(staged)
    try:
        df.write.parquet(staged)
        for name, audit in audits:
            if not audit(spark.read.parquet(staged)).isEmpty():
                raise ValueError(f"audit failed: {name}")
        if fs.exists(target) or not fs.rename(place, target):
            raise FileExistsError(path)
    finally:
        if fs.exists(place):
            fs.delete(place, True)
