"""Draws that must come out exactly: a reserve of whole groups up to a capacity, and groups that no source is in twice.

Both are sequential rules. Here the driver only learns sums over prefixes of a digest or over a grid of
candidate counts, a few hundred numbers at a time, and the rows are decided by the limits found.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import hash_order
from .staging import Staging

#: Groups of one digest prefix that the driver walks through one by one.
LEAF = 4096
#: Candidates that one pass over the sources' counts tries.
PROBES = 64


def _any(tests: list[Column]) -> Column:
    """The disjunction as a balanced tree, so that many tests stay a shallow expression."""
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0] if tests else F.lit(False)


def _accepted(sizes: DataFrame, capacity: int) -> tuple[list[tuple[str, str, int]], int]:
    """Open intervals of digests with the greatest size accepted in each, and the capacity left over.

    A round finds, digit by digit, the digest prefix in which the sums outgrow what is left; the groups of that
    prefix are walked through, and what follows goes on with less.
    """
    d, n = F.col("d"), F.col("n")
    taken, left, after = [], capacity, ""
    while left > 0:
        rest = sizes.where((d > after) & (n <= left))
        prefix, before = "", 0
        while True:
            here = rest.where(d.startswith(prefix)) if prefix else rest
            sums = here.groupBy(F.substring(d, len(prefix) + 1, 2).alias("b")).agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("k")).collect()
            over = None
            for r in sorted(sums, key=lambda r: r.b):
                if before + r.s > left:
                    over = r
                    break
                before += r.s
            if over is None:
                return taken + [(after, "~", left)], left - before
            prefix += over.b
            if over.k <= LEAF:
                break
        taken.append((after, prefix, left))
        left -= before
        low, most, last = prefix, left, prefix
        for r in rest.where(d.startswith(prefix)).select("d", "n").orderBy("d").collect():
            last = r.d
            if r.n > most:
                continue
            if r.n <= left:
                left -= r.n
            else:
                taken.append((low, r.d, most))
                low, most = r.d, left
        taken.append((low, last + "~", most))
        after = last
    return taken, left


def exact_reserve(df: DataFrame, group: str, capacity: int, seed: str, exact: bool = False) -> DataFrame:
    """``df`` with ``reserved``: whole groups in digest order while they fit; one that does not fit is passed over.

    Rows without a group are never reserved. With ``exact`` a reserve of fewer than ``capacity`` rows is an error.
    Jobs run while the plan is built; the driver sees 256 sums, or up to ``LEAF`` groups, at a time.
    """
    if capacity < 0:
        raise ValueError("a capacity of 0 or more")
    st = Staging(df.sparkSession, "reserve")
    with st:
        counted = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("n"))
        sizes = st.table(counted.select("_g", "n", hash_order("_g", seed).alias("d")))
        taken, left = _accepted(sizes, capacity)
        if exact and left:
            raise ValueError(f"{left} rows short of an exact reserve of {capacity}")
        inside = _any([(F.col("d") > low) & (F.col("d") < high) & (F.col("n") <= most) for low, high, most in taken])
        chosen = st.keep(sizes.where(inside).select("_g", F.lit(True).alias("_in")))
    return df.join(chosen, F.col(group) == F.col("_g"), "left").select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_in", F.lit(False)).alias("reserved"))


def _before(df: DataFrame, digest: str, amount: Column, name: str) -> DataFrame:
    """The sum of ``amount`` over rows of smaller digest, by ranges of the digest side by side."""
    rows = df.withColumns({"_b": F.substring(digest, 1, 3), "_a": amount})
    sums = rows.groupBy("_b").agg(F.sum("_a").alias("_s"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, 4,096 at most
    carried = sums.select("_b", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_o"))
    own = Window.partitionBy("_b").orderBy(digest).rowsBetween(Window.unboundedPreceding, -1)
    told = rows.join(F.broadcast(carried), "_b").withColumn(name, F.col("_o") + F.coalesce(F.sum("_a").over(own), F.lit(0)))
    return told.drop("_b", "_a", "_o")


def _spread_rank(df: DataFrame, source: str, key: str, seed: str) -> DataFrame:
    """Rows numbered from 1 within their source in digest order; a large source is numbered by ranges of the digest."""
    rows = df.withColumn("_d", hash_order(key, seed)).withColumn("_b", F.substring("_d", 1, 2))
    sums = rows.groupBy(source, "_b").agg(F.count(F.lit(1)).alias("_s"))
    upto = Window.partitionBy(source).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows of a source at most
    carried = sums.select(F.col(source).alias("_src"), F.col("_b").alias("_rb"), F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_o"))
    own = F.row_number().over(Window.partitionBy(source, "_b").orderBy("_d", key))
    told = rows.withColumn("_n", own).join(carried, (F.col(source) == F.col("_src")) & (F.col("_b") == F.col("_rb")))
    return told.withColumn("rank", F.col("_o") + F.col("_n")).drop("_d", "_b", "_src", "_rb", "_o", "_n")


def _last(holds: Callable[[list[int]], list[bool]], high: int) -> int:
    """The greatest number up to ``high`` for which a test holds that holds from 0 up to some number."""
    low = 0
    while low < high:
        step = -(-(high - low) // PROBES)
        at = [*range(low + step, high, step), high]
        ok = holds(at)
        k = ok.index(False) if False in ok else len(ok)
        low, high = (at[k - 1] if k else low), (at[k] - 1 if k < len(at) else high)
    return low


def disjoint_groups(df: DataFrame, source: str, key: str, seed: str, size: int, quota: int | None = None) -> DataFrame:
    """``(source, key, group_id)``: as many groups of ``size`` rows as there can be with no source twice in one, no row in two.

    A source gives at most ``quota`` rows, its first by digest. G groups can be had where the sources together
    give G * size rows with at most G from each; what is beyond that is spared round by round, so that sources that
    gave most run a deficit first. Rows are dealt in turn, source after source, which keeps two rows of
    a source a whole turn apart. Rows without a source or key take no part; too few sources give no group.
    """
    if size < 1 or (quota is not None and quota < 1):
        raise ValueError("a size and a quota of 1 or more")
    st = Staging(df.sparkSession, "disjoint")
    with st:
        named = df.where(F.col(source).isNotNull() & F.col(key).isNotNull()).select(source, key)
        ranked = _spread_rank(named, source, key, seed)
        rows = st.table(ranked if quota is None else ranked.where(F.col("rank") <= quota))
        counts = st.table(rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")).withColumn("d", hash_order(source, seed)))

        def given(at: list[int], most: int | None = None) -> list[int]:
            n = F.col("n") if most is None else F.least("n", F.lit(most))
            got = counts.agg(*[F.coalesce(F.sum(F.least(n, F.lit(g))), F.lit(0)).alias(f"s{i}") for i, g in enumerate(at)]).first()
            return [int(v) for v in got]

        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first().s
        groups = _last(lambda at: [s >= size * g for s, g in zip(given(at), at)], total // size)
        if not groups:
            return named.limit(0).withColumn("group_id", F.lit(0).cast("long"))
        rounds = _last(lambda at: [s <= size * groups for s in given(at, groups)], groups)
        spare = size * groups - given([rounds], groups)[0]
        capped = F.least("n", F.lit(groups))
        more = _before(counts, "d", (capped > rounds).cast("long"), "ahead")
        kept = more.withColumn("kept", F.least(capped, F.lit(rounds)) + ((capped > rounds) & (F.col("ahead") < spare)).cast("long"))
        placed = _before(kept, "d", F.col("kept"), "first").select(F.col(source).alias("_src"), "kept", "first")
        told = rows.join(placed, F.col(source) == F.col("_src")).where(F.col("rank") <= F.col("kept"))
        return st.keep(told.select(source, key, ((F.col("first") + F.col("rank") - 1) % groups).alias("group_id")))
