"""Choosing rows and groups: exclusions, representative cases, balanced and disjoint groups, whole-block splits, free windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import hash_order, ranked


def exclusions(sources: list[DataFrame], key: str) -> DataFrame:
    """The ids that any of several lists names, once each; nulls are none."""
    return reduce(DataFrame.union, [s.select(key) for s in sources]).where(F.col(key).isNotNull()).distinct()


def select_rows(df: DataFrame, excluded: DataFrame, key: str, rules: list[Column]) -> DataFrame:
    """Rows that hold all rules and whose key no exclusion names."""
    return df.where(reduce(lambda a, b: a & b, rules)).join(excluded.select(key), key, "left_anti")


def population_differences(whole: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """``(key, problem)``: keys only one side has, and those a side has more than once."""
    a = whole.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    b = part.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    both = a.join(b, key, "full")
    problem = F.when(F.col("m").isNull(), "missing").when(F.col("n").isNull(), "unknown").when((F.col("n") > 1) | (F.col("m") > 1), "repeated")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def keep_best(df: DataFrame, identity: list[str], score: str, order: str) -> DataFrame:
    """Of rows with the same identity the one of the greatest score, the first of equals by ``order``."""
    w = Window.partitionBy(*identity).orderBy(F.desc(score), order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def median_case(df: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    """The row of each group whose value is nearest to the group's median; ties to the smaller key."""
    middle = df.groupBy(*group).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    told = df.join(middle, group)
    best = F.min(F.struct(F.abs(F.col(value) - F.col("median")).alias("d"), F.col(key).alias("key"), F.col(value).alias("value")))
    return told.where(F.col(value).isNotNull()).groupBy(*group, "median").agg(best.alias("b")).select(*group, "median", F.col("b.key").alias(key), F.col("b.value").alias(value))


def nearest_to_guard(df: DataFrame, group: list[str], position: Column, period: int, guard: int, key: list[str]) -> DataFrame:
    """Of each group the row that stays clear of the joins every ``period`` by at least ``guard``, yet nearest to one; ties by key."""
    off = F.pmod(position, F.lit(period))
    told = df.withColumn("distance", F.least(off, period - off)).where(F.col("distance") >= guard)
    w = Window.partitionBy(*group).orderBy("distance", *key)
    return told.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*group, *key, "distance")


def accepted_of_top(df: DataFrame, group: list[str], score: str, key: str, k: int, accept: Column) -> DataFrame:
    """``(group, accepted)``: how many of the k rows of the greatest scores pass; the cut comes before the test."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), key)
    top = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy(*group).agg(F.count_if(accept).alias("accepted"))


def balanced_groups(df: DataFrame, label: str, source: str, key: str, seed: str, per_label: int, labels: int) -> DataFrame:
    """``(key, label, source, drawn)``: disjoint groups with ``per_label`` rows of every label, each source in one row at most.

    Of each source and label the first row by digest stands for the source; the groups are consecutive
    in digest order within labels, and only those that all labels fill are given.
    """
    once = ranked(df, [source], key, seed + ":source", "_s").where("_s = 1")
    turn = ranked(once, [label], key, seed, "_r")
    numbered = turn.withColumn("drawn", F.floor((F.col("_r") - 1) / per_label).cast("int"))
    full = numbered.groupBy("drawn").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == per_label * labels)
    return numbered.join(full, "drawn").select(key, label, source, "drawn")


def blocks_60_20_20(df: DataFrame, stratum: str, block: str, seed: str) -> DataFrame:
    """Whole blocks of each stratum to train, val and test: three or more by shares of 60, 20 and 20 %, two to train and test, one to train."""
    blocks = df.select(stratum, block).distinct()
    w = Window.partitionBy(stratum)
    n, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(hash_order(block, seed), block))
    quota = F.greatest(F.lit(1), F.rint(n * 0.2))
    role = F.when(n == 1, "train").when(r <= quota, "test").when((n > 2) & (r <= 2 * quota), "val").otherwise("train")
    return df.join(blocks.select(stratum, block, role.alias("split")), [stratum, block])


def group_partition(df: DataFrame, stratum: str, group: str, seed: str, calibration: float) -> DataFrame:
    """``df`` with ``part``: whole groups to calibration or fit, in digest order, by their share of groups, at least one to each where there are two."""
    groups = df.select(stratum, group).distinct()
    w = Window.partitionBy(stratum)
    n, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(hash_order(group, seed), group))
    quota = F.least(F.greatest(F.rint(n * calibration), F.lit(1)), n - 1)
    return df.join(groups.select(stratum, group, F.when(r <= quota, "calibration").otherwise("fit").alias("part")), [stratum, group])


def free_windows(spans: DataFrame, events: DataFrame, key: str, width: int, step: int, guard: int) -> DataFrame:
    """``(key, start, end)``: windows on a grid over each key's span that no event, widened by ``guard``, meets.

    Events become the grid cells they touch, so that the anti-join is on equal keys.
    """
    starts = F.sequence(F.col("start"), F.col("end") - width, F.lit(step).cast("long"))
    grid = spans.where(F.col("end") - F.col("start") >= width).select(key, F.col("start").alias("origin"), F.explode(starts).alias("start"))
    grid = grid.withColumn("cell", ((F.col("start") - F.col("origin")) / step).cast("long"))
    low = F.floor((F.col("e.start") - guard - F.col("s.start") - width) / step) + 1
    # no event reaches beyond the last cell of its key's span
    high = F.least(F.ceil((F.col("e.end") + guard - F.col("s.start")) / step) - 1, F.floor((F.col("s.end") - F.col("s.start") - width) / step))
    met = events.alias("e").join(spans.alias("s"), F.col(f"e.{key}") == F.col(f"s.{key}")).select(F.col(f"e.{key}").alias(key), F.greatest(F.lit(0), low).cast("long").alias("low"), high.cast("long").alias("high"))
    cells = met.where("high >= low").select(key, F.explode(F.sequence("low", "high")).alias("cell")).distinct()
    return grid.join(cells, [key, "cell"], "left_anti").select(key, "start", (F.col("start") + width).alias("end"))


def listed_bounds(files: DataFrame, ids: str, candidates: DataFrame, key: str, quality: str, judged: str) -> DataFrame:
    """By quality: how many candidates stand in files' lists of ids, and the least and most of them that are wrong.

    ``ids`` is a list as JSON text; ``judged`` says how many of a file's are known to be wrong.
    """
    told = files.select(F.monotonically_increasing_id().alias("_f"), judged, F.from_json(ids, "array<long>").alias("_ids"))
    one = told.withColumn("_n", F.size("_ids")).select("_f", judged, "_n", F.explode("_ids").alias(key))
    by = one.join(candidates.select(key, quality), key).groupBy("_f", judged, "_n", quality).agg(F.count(F.lit(1)).alias("n"))
    others = F.col("_n") - F.col("n")
    low, high = F.greatest(F.lit(0), F.col(judged) - others), F.least(F.col(judged), F.col("n"))
    return by.groupBy(quality).agg(F.sum("n").alias("listed"), F.sum(low).alias("least_wrong"), F.sum(high).alias("most_wrong"))


def merge_rule(iou: Column, center_gap: Column, frequency_gap: Column, score_gap: Column, duplicate: float, overlap: float, near: float, tone: float, unsure: float) -> Column:
    """Which rule makes two candidates one: ``duplicate`` by overlap alone, ``same`` by overlap, place and tone, ``unsure`` by place or tone and a small difference of scores."""
    close, alike = center_gap <= near, frequency_gap <= tone
    return F.when(iou >= duplicate, "duplicate").when((iou >= overlap) & close & alike, "same").when((iou >= overlap) & (close | alike) & (score_gap <= unsure), "unsure")


def boundary_decision(center: Column, intervals: Column, radius: float, supported: Column) -> Column:
    """Whether a proposal near the edge of a replaced interval stands: struct(distance, near, kept, reason)."""
    edges = F.flatten(F.transform(intervals, lambda i: F.array(i["start"], i["end"])))
    distance = F.array_min(F.transform(edges, lambda e: F.abs(center - e)))
    inside = F.exists(intervals, lambda i: (i["start"] <= center) & (center < i["end"]))
    near = F.coalesce(distance <= radius, F.lit(False)) | inside
    reason = F.when(inside, "inside").when(near & ~supported, "no_clean_support").when(near, "supported").otherwise("clear")
    return F.struct(distance.alias("distance"), near.alias("near"), (~inside & (~near | supported)).alias("kept"), reason.alias("reason"))
