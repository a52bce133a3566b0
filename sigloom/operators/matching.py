"""Joins by tolerance, containment and nearness, and one-to-one matching within a key.

Range joins are equi-joins on buckets: each row of one side is put in its bucket,
the other side in every bucket that it can reach, so no key is crossed with another.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keys else prefix + c) for c in df.columns])


def within(left: DataFrame, right: DataFrame, keys: list[str], at: str, tolerance: float, how: str = "inner") -> DataFrame:
    """Pairs whose ``at`` differs by at most ``tolerance``; columns get the prefixes l_ and r_.

    ``how`` is inner, left, left_semi or left_anti: the right side stands in several buckets, so its
    unmatched rows can't be told.
    """
    if how not in ("inner", "left", "left_semi", "left_anti") or tolerance < 0:
        raise ValueError("how must be inner, left, left_semi or left_anti, and the tolerance not negative")
    width = tolerance or 1.0
    lo = _prefixed(left, "l_", keys).withColumn("_b", F.floor(F.col(f"l_{at}") / width))
    ro = _prefixed(right, "r_", keys).withColumn("_b", F.explode(F.sequence(F.floor(F.col(f"r_{at}") / width) - 1, F.floor(F.col(f"r_{at}") / width) + 1)))
    on = [lo[k] == ro[k] for k in [*keys, "_b"]] + [F.abs(lo[f"l_{at}"] - ro[f"r_{at}"]) <= tolerance]
    out = lo.join(ro, on, how)
    return out.select(*[lo[k] for k in keys], *[c for c in out.columns if c.startswith(("l_", "r_"))])


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, bucket: float) -> DataFrame:
    """Points with every interval [start, end] of their key that holds them; prefixes l_ and r_."""
    p = _prefixed(points, "l_", keys).withColumn("_b", F.floor(F.col(f"l_{at}") / bucket))
    i = _prefixed(intervals, "r_", keys).withColumn("_b", F.explode(F.sequence(F.floor(F.col("r_start") / bucket), F.floor(F.col("r_end") / bucket))))
    out = p.join(i, [p[k] == i[k] for k in [*keys, "_b"]] + [(p[f"l_{at}"] >= i.r_start) & (p[f"l_{at}"] <= i.r_end)])
    return out.select(*[p[k] for k in keys], *[c for c in out.columns if c.startswith(("l_", "r_"))])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, key: str) -> DataFrame:
    """For each left row the right row of its key with the nearest ``at``; ties to the earlier one.

    A sort of both sides together: the last right row before and the first after decide, with no pairs made.
    """
    kinds = dict(right.dtypes)
    a = left.select(*keys, F.col(key).alias("l_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kinds[key]).alias("_rk"))
    b = right.select(*keys, F.lit(None).cast(dict(left.dtypes)[key]).alias("l_key"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(key).alias("_rk"))
    u = a.unionByName(b).withColumn("_hit", F.when(F.col("_side") == 0, F.struct(F.col("_at"), F.col("_rk"))))
    w = Window.partitionBy(*keys)
    before = F.last("_hit", ignorenulls=True).over(w.orderBy("_at", "_side", F.desc("_rk")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_hit", ignorenulls=True).over(w.orderBy("_at", F.desc("_side"), "_rk").rowsBetween(0, Window.unboundedFollowing))
    both = u.withColumn("_p", before).withColumn("_n", after).where("_side = 1")
    dp, dn = F.col("_at") - F.col("_p._at"), F.col("_n._at") - F.col("_at")
    pick = F.when(F.col("_p").isNull() | (dn < dp), F.col("_n")).otherwise(F.col("_p"))
    out = both.withColumn("_x", pick)
    return out.select(*keys, F.col("l_key"), F.col("_x._rk").alias("r_key"), F.abs(F.col("_x._at") - F.col("_at")).alias("distance"))


def self_overlaps(df: DataFrame, keys: list[str], key: str, bucket: float) -> DataFrame:
    """Pairs of a key's intervals that overlap (open), the lesser id first."""
    rows = df.select(*keys, key, "start", "end").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end")) / bucket))))
    a, b = _prefixed(rows, "l_", [*keys, "_b"]), _prefixed(rows, "r_", [*keys, "_b"])
    on = [a[k] == b[k] for k in [*keys, "_b"]] + [a[f"l_{key}"] < b[f"r_{key}"], a.l_start < b.r_end, a.l_end > b.r_start]
    # a pair that shares several buckets counts in the one where its overlap begins
    on.append(F.floor(F.greatest(a.l_start, b.r_start) / bucket) == a["_b"])
    out = a.join(b, on)
    return out.select(*[a[k] for k in keys], f"l_{key}", f"r_{key}", (F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("overlap"))


def with_islands(df: DataFrame, keys: list[str], low: Column, high: Column, apart: float = 0.0) -> DataFrame:
    """``df`` with ``_island``: within a key, rows between which no chain of [low, high] leads have different numbers.

    A new one begins where low is more than ``apart`` beyond all ends before, which one running maximum tells.
    """
    told = df.withColumns({"_low": low, "_high": high})
    w = Window.partitionBy(*keys).orderBy("_low", "_high")
    told = told.withColumn("_reach", F.max("_high").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("_low") - F.col("_reach") > apart, 1).otherwise(0)
    return told.withColumn("_island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_low", "_high", "_reach")


def greedy_pairs(pairs: list[tuple], left: int = 0, right: int = 1) -> list[tuple]:
    """Pairs taken in the given order, each side once."""
    used: tuple[set, set] = (set(), set())
    out = []
    for p in pairs:
        if p[left] not in used[0] and p[right] not in used[1]:
            used[0].add(p[left])
            used[1].add(p[right])
            out.append(p)
    return out


def _begins(t: pa.Table, columns: list[str]) -> np.ndarray:
    """Rows of a sorted table at which one of the columns changes."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for c in columns:
        x = t.column(c).combine_chunks()
        x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
        a, b = x.slice(1), x.slice(0, len(x) - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(out)


def each_island(told: DataFrame, keys: list[str], schema: str, alone: Callable[[pa.Table], pa.Table | None], run: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``run`` on the rows of every island of several rows, ``alone`` on all others at once (None: they give nothing).

    Islands are dealt by key and number and stream through a task in order, which holds a batch and
    the island that is not yet whole. Only islands of several rows cost a call.
    """
    by = [*keys, "_island"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            size = np.diff(np.r_[starts, t.num_rows])
            single = alone(t.take(pa.array(starts[size == 1]))) if (size == 1).any() else None
            made = [run(t.slice(i, n)) for i, n in zip(starts[size > 1].tolist(), size[size > 1].tolist())]
            for part in ([single] if single is not None else []) + ([pa.concat_tables(made)] if made else []):
                yield from part.combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            starts = _begins(t, by)
            if len(starts) > 1:
                yield from solved(t.slice(0, starts[-1]), starts[:-1])
            held = t.slice(starts[-1]).to_batches()
        if held:
            yield from solved(pa.Table.from_batches(held), np.zeros(1, np.int64))

    return told.repartition(*by).sortWithinPartitions(*by).mapInArrow(stream, schema)


def greedy_match(left: DataFrame, right: DataFrame, keys: list[str], at: str, key: str, tolerance: float) -> DataFrame:
    """One-to-one pairs within the tolerance, the closest first, ties by left and right id."""
    pairs = within(left.select(*keys, key, at), right.select(*keys, key, at), keys, at, tolerance)
    pairs = pairs.select(*keys, F.col(f"l_{key}").alias("l_key"), F.col(f"r_{key}").alias("r_key"), F.abs(F.col(f"l_{at}") - F.col(f"r_{at}")).alias("distance"))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("distance", "l_key", "r_key")], range(table.num_rows)))
        return table.take(pa.array([r[3] for r in greedy_pairs(rows, 1, 2)], pa.int64()))

    return pairs.groupBy(*keys).applyInArrow(run, pairs.schema)


def assign(utility: np.ndarray) -> list[tuple[int, int]]:
    """Optimal one-to-one assignment of greatest total utility; pairs without positive utility stay open.

    Shortest augmenting paths with potentials, on the square matrix filled up with zeros.
    """
    n = max(utility.shape) if utility.size else 0
    cost = np.zeros((n, n))
    cost[: utility.shape[0], : utility.shape[1]] = -np.maximum(utility, 0) if utility.size else 0
    u, v = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for i in range(n):
        dist, seen, prev = np.full(n, np.inf), np.zeros(n, bool), np.full(n, -1)
        row, last, base = i, -1, 0.0
        while True:
            d = base + cost[row] - u[row] - v
            better = ~seen & (d < dist)
            dist[better], prev[better] = d[better], last
            j = int(np.where(seen, np.inf, dist).argmin())
            seen[j], base = True, dist[j]
            if row_of[j] < 0:
                break
            row, last = int(row_of[j]), j
        done = seen.copy()
        done[j] = False
        u[i] += base
        for q in np.flatnonzero(done):
            u[row_of[q]] += base - dist[q]
            v[q] -= base - dist[q]
        while True:
            p = int(prev[j])
            row_of[j] = i if p < 0 else row_of[p]
            if p < 0:
                break
            j = p
    return sorted((int(r), c) for c, r in enumerate(row_of.tolist()) if r < utility.shape[0] and c < utility.shape[1] and utility[r, c] > 0)


def optimal_match(left: DataFrame, right: DataFrame, keys: list[str], key: str, reach: float = 512.0) -> DataFrame:
    """One-to-one pairs of intervals of a key with the greatest total of 1000 + IoU - 1e-7 distance.

    Eligible are pairs that overlap or whose centers are within ``reach``; IoU is over the hull.
    Keys that one side lacks give no pairs. A key is solved island by island: intervals of
    different ones are never eligible, so that the whole's optimum is theirs together.
    """
    kind = dict(left.dtypes)
    schema = ", ".join([*(f"`{k}` {kind[k]}" for k in keys), f"l_key {kind[key]}", f"r_key {dict(right.dtypes)[key]}", "iou double"])

    def run(both: pa.Table) -> pa.Table:
        both = both.sort_by([("start", "ascending"), (key, "ascending")])
        a, b = both.filter(both.column("_left")), both.filter(pc.invert(both.column("_left")))
        (s, e), (t, f) = ([x.column(c).to_numpy().astype(float) for c in ("start", "end")] for x in (a, b))
        inter = np.clip(np.minimum(e[:, None], f) - np.maximum(s[:, None], t), 0, None)
        hull = np.maximum(e[:, None], f) - np.minimum(s[:, None], t)
        iou = np.divide(inter, hull, out=np.zeros_like(inter), where=hull > 0)
        delta = np.abs((s + e)[:, None] / 2 - (t + f) / 2)
        got = assign(np.where((iou > 0) | (delta <= reach), 1000 + iou - 1e-7 * delta, 0.0)) if len(s) and len(t) else []
        i, j = [p[0] for p in got], [p[1] for p in got]
        cols = {k: a.column(k).take(pa.array(i, pa.int64())) for k in keys}
        return pa.table({**cols, "l_key": a.column(key).take(pa.array(i, pa.int64())), "r_key": b.column(key).take(pa.array(j, pa.int64())), "iou": pa.array([float(iou[p]) for p in got], pa.float64())})

    cols = [*keys, key, "start", "end"]
    both = left.select(*cols, F.lit(True).alias("_left")).unionByName(right.select(*cols, F.lit(False).alias("_left")))
    center = (F.col("start") + F.col("end")) / 2
    told = with_islands(both, keys, F.least(F.col("start"), center - reach / 2), F.greatest(F.col("end"), center + reach / 2))
    return each_island(told, keys, schema, lambda t: None, run)


def suppress(df: DataFrame, keys: list[str], key: str, score: str, iou: float) -> DataFrame:
    """Greedy temporal suppression: by score, then id, a row is dropped by the kept one it overlaps most, at ``iou`` or more.

    ``kept_by`` names the kept row, null for rows that stay. Sequential within an island of a key, as
    rows that no chain of overlaps joins can't drop each other; ``iou`` is above zero.
    """
    rows = df.select(*keys, key, "start", "end", score)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"kept_by {dict(df.dtypes)[key]}"])

    def run(table: pa.Table) -> pa.Table:
        s, e = (table.column(c).to_numpy().astype(float) for c in ("start", "end"))
        ids = table.column(key).to_pylist()
        sc = np.nan_to_num(table.column(score).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
        kept: list[int] = []
        by = [None] * len(ids)
        for i in sorted(range(len(ids)), key=lambda i: (-sc[i], ids[i])):
            if kept:
                k = np.array(kept)
                inter = np.clip(np.minimum(e[i], e[k]) - np.maximum(s[i], s[k]), 0, None)
                hull = np.maximum(e[i], e[k]) - np.minimum(s[i], s[k])
                v = np.divide(inter, hull, out=np.zeros_like(inter), where=hull > 0)
                if v.max() >= iou:
                    by[i] = ids[kept[int(v.argmax())]]
                    continue
            kept.append(i)
        return table.drop_columns(["_island"]).append_column("kept_by", pa.array(by, table.schema.field(key).type))

    def alone(table: pa.Table) -> pa.Table:
        return table.drop_columns(["_island"]).append_column("kept_by", pa.nulls(table.num_rows, table.schema.field(key).type))

    return each_island(with_islands(rows, keys, F.col("start"), F.col("end")), keys, schema, alone, run)


def drifting_dedup(df: DataFrame, keys: list[str], key: str, frequency: str, time: str, energy: str, d_frequency: float, d_time: float) -> DataFrame:
    """Greedy dedup in id order: a row joins the first representative close in frequency and time, and replaces it if it has more energy.

    Sequential within an island of a key: rows on either side of a gap of ``d_time`` are never close.
    """
    rows = df.select(*keys, key, frequency, time, energy)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(key, "ascending")])
        f, t, e = (table.column(c).to_numpy() for c in (frequency, time, energy))
        reps: list[int] = []
        for i in range(len(f)):
            for n, r in enumerate(reps):
                if abs(f[i] - f[r]) < d_frequency and abs(t[i] - t[r]) < d_time:
                    if e[i] > e[r]:
                        reps[n] = i
                    break
            else:
                reps.append(i)
        return table.drop_columns(["_island"]).take(pa.array(reps, pa.int64()))

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return each_island(with_islands(rows, keys, F.col(time), F.col(time), d_time), keys, schema, lambda t: t.drop_columns(["_island"]), run)


def spaced_choice(df: DataFrame, keys: list[str], start: str, value: str, apart: float, most: int) -> DataFrame:
    """Rows of least value, in order, each at least ``apart`` from those already chosen, at most ``most`` a key."""
    rows = df.select(*keys, start, value)

    def run(table: pa.Table) -> pa.Table:
        s, v = table.column(start).to_pylist(), table.column(value).to_pylist()
        heap = [(v[i], s[i], i) for i in range(len(s))]
        heapq.heapify(heap)
        chosen: list[int] = []
        while heap and len(chosen) < most:
            _, at, i = heapq.heappop(heap)
            if all(abs(at - s[j]) >= apart for j in chosen):
                chosen.append(i)
        return table.take(pa.array(chosen, pa.int64()))

    return rows.groupBy(*keys).applyInArrow(run, rows.schema)


def nearest_vector(queries: DataFrame, reference: DataFrame, key: str, features: list[str], scales: dict[str, float], weights: dict[str, float] | None = None, exclude_self: bool = False, block: int = 4096) -> DataFrame:
    """The nearest reference row of each query in weighted, scaled Euclidean distance; ties to the lesser id.

    Reference rows are dealt in blocks; queries meet every block, and each block gives one row a query.
    """
    weights = weights or {}
    n = max(1, -(-reference.count() // block))
    r = reference.select(F.col(key).alias("id"), *features).withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(n)))
    q = queries.select(F.col(key).alias("id"), *features).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    m = np.array([np.sqrt(weights.get(f, 1.0)) / scales.get(f, 1.0) for f in features])
    kq, kr = dict(queries.dtypes)[key], dict(reference.dtypes)[key]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"id": [], "nearest": [], "distance": []}
        if a.num_rows and b.num_rows:
            b = b.sort_by([("id", "ascending")])
            x, y = (np.stack([t.column(f).to_numpy().astype(float) for f in features], 1) * m for t in (a, b))
            ids = b.column("id").to_pylist()
            for i, name in enumerate(a.column("id").to_pylist()):
                d = np.sqrt(((y - x[i]) ** 2).sum(1))
                if exclude_self:
                    d[np.array([k == name for k in ids])] = np.inf
                j = int(d.argmin())
                if np.isfinite(d[j]):
                    out["id"].append(name)
                    out["nearest"].append(ids[j])
                    out["distance"].append(float(d[j]))
        return pa.table({"id": pa.array(out["id"], a.schema.field("id").type), "nearest": pa.array(out["nearest"], b.schema.field("id").type), "distance": pa.array(out["distance"], pa.float64())})

    found = q.groupBy("_b").cogroup(r.groupBy("_b")).applyInArrow(run, f"id {kq}, nearest {kr}, distance double")
    best = found.groupBy("id").agg(F.min(F.struct("distance", "nearest")).alias("x"))
    return best.select(F.col("id").alias(key), "x.nearest", "x.distance")


def approximately_equal(pairs: list[tuple[Column, Column, float]]) -> Column:
    """All pairs of columns within their tolerances."""
    out = F.lit(True)
    for a, b, tol in pairs:
        out = out & (F.abs(a - b) <= tol)
    return out
