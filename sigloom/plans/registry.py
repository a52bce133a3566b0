"""Registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with the SQL that must give the same rows."""

    if name in QUERIES:
        raise ValueError(f"there is a query {name} already")

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "class_summary",
    """SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_value,
              round(stddev_pop(value), 6) AS std_value FROM events GROUP BY event_type""",
)
def class_summary(spark, sf_dir):
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.stddev_pop("value"), 6).alias("std_value"))
    )
