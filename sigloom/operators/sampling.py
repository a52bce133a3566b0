"""Deterministic ordering, sampling and splitting by digests: reproducible on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import hash_hex


def hash_order(key: Column | str, seed: str) -> Column:
    """A digest to order by; ties are broken by the key itself where it is used."""
    return hash_hex(seed, F.col(key).cast("string") if isinstance(key, str) else key)


def ranked(df: DataFrame, strata: list[str], key: str, seed: str, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in the digest order of ``key`` within strata."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*strata).orderBy(hash_order(key, seed), key)))


def split(df: DataFrame, strata: list[str], key: str, seed: str, fraction: float, least: int = 1) -> DataFrame:
    """``held_out``: the first rint(n f) rows of a stratum by digest, at least ``least``, never all of it."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*strata))
    quota = F.least(F.greatest(F.rint(n * fraction), F.lit(least)), n - 1)
    return ranked(df, strata, key, seed, "_r").withColumn("held_out", F.col("_r") <= quota).drop("_r")


def block_split(df: DataFrame, group: str, block: str, seed: str, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Whole blocks to train, val or test within a group; groups of fewer than three blocks are all train."""
    blocks = df.select(group, block).distinct()
    w = Window.partitionBy(group)
    n = F.count(F.lit(1)).over(w)
    r = F.row_number().over(w.orderBy(hash_order(block, seed), block))
    n_val, n_test = F.greatest(F.lit(1), F.rint(n * val)), F.greatest(F.lit(1), F.rint(n * test))
    role = F.when(n < 3, "train").when(r <= n_test, "test").when(r <= n_test + n_val, "val").otherwise("train")
    return df.join(blocks.select(group, block, role.alias("split")), [group, block])


def quota_per_group(df: DataFrame, group: str, key: str, seed: str, quota: int, first: Column | None = None) -> DataFrame:
    """At most ``quota`` rows of each group by digest; rows where ``first`` holds come before the others."""
    order = [F.when(first, 0).otherwise(1)] if first is not None else []
    w = Window.partitionBy(group).orderBy(*order, hash_order(key, seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quota).drop("_r")


def round_robin(df: DataFrame, strata: list[str], key: str, seed: str, quota: int) -> DataFrame:
    """``quota`` rows dealt from strata in turn, each in digest order."""
    out = ranked(df, strata, key, seed, "round").withColumn("stratum", F.concat_ws("|", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata]))
    return out.orderBy("round", "stratum", key).limit(quota)


def stratified_fraction(df: DataFrame, strata: list[str], key: str, seed: str, fraction: float) -> DataFrame:
    """One row of each stratum, then others by digest, to ceil(f n) rows in all."""
    total = df.count()
    want = -(-int(round(total * fraction * 1_000_000)) // 1_000_000)
    first = ranked(df, strata, key, seed, "_r")
    return first.orderBy(F.when(F.col("_r") == 1, 0).otherwise(1), hash_order(key, seed), key).limit(max(want, 0)).drop("_r")


def balanced(df: DataFrame, group: list[str], label: str, key: str, seed: str) -> DataFrame:
    """Each label of a group undersampled to its rarest label's rows."""
    sizes = df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("_n"))
    least = sizes.groupBy(*group).agg(F.min("_n").alias("_least")) if group else sizes.agg(F.min("_n").alias("_least"))
    joined = ranked(df, [*group, label], key, seed, "_r")
    joined = joined.join(least, group) if group else joined.crossJoin(F.broadcast(least))  # a single row
    return joined.where(F.col("_r") <= F.col("_least")).drop("_r", "_least")


def folds(df: DataFrame, strata: list[str], key: str, seed: str, n: int) -> DataFrame:
    """Fold 0..n-1 by digest order, equal to one row within each stratum."""
    return ranked(df, strata, key, seed, "_r").withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(n)).cast("int")).drop("_r")


def rotation(df: DataFrame, strata: list[str], key: str, offset: int) -> DataFrame:
    """Each row of a stratum paired with the one ``offset`` places on, never itself; single rows have none."""
    w = Window.partitionBy(*strata)
    numbered = df.select(*strata, key).distinct()
    numbered = numbered.withColumn("_r", F.row_number().over(w.orderBy(key)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = 1 + F.pmod(F.lit(offset), F.col("_n") - 1)
    left = numbered.where("_n > 1").withColumn("_to", F.pmod(F.col("_r") + step, F.col("_n")))
    right = numbered.select(*strata, F.col(key).alias("partner"), F.col("_r").alias("_to"))
    return left.join(right, [*strata, "_to"]).select(*strata, key, "partner")


def latest(df: DataFrame, key: list[str], revision: str, line: str) -> DataFrame:
    """The row of each key with the highest revision, the earliest of equals."""
    w = Window.partitionBy(*key).orderBy(F.desc(revision), line)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def extremes(df: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    """The rows of least and greatest value of each group, ties to the least key."""
    lo = F.min_by(F.struct(key, value), F.struct(F.col(value), F.col(key))).alias("lo")
    hi = F.min_by(F.struct(key, value), F.struct((-F.col(value)).alias("v"), F.col(key))).alias("hi")
    both = df.where(F.col(value).isNotNull()).groupBy(*group).agg(lo, hi)
    return both.select(*group, F.explode(F.array(F.struct(F.lit("min").alias("role"), F.col("lo").alias("x")), F.struct(F.lit("max").alias("role"), F.col("hi").alias("x")))).alias("r")).select(*group, "r.role", f"r.x.{key}", f"r.x.{value}")
