"""Nearest rows in a few scaled features, by an exact index of cells, and the coverage of populations built on it.

Every different reference point lies in a cell, and cells that hold too many points are cut on by
the next finer grid, so that there are some thousands of cells with the box around their points. A query first goes to
the cell whose box is nearest and then, with what it found there, to the other cells whose box may hold something as near. Queries and points of a cell meet
in one task, in parts, which goes through leaves of a tree over the cell's points. Nothing but found rows leaves a task, so that
what is written grows with the queries alone. Points that are equal in all features count as one, on both sides, so that a
heap of copies is neither searched nor searching more than once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import Staging

#: Different points in a leaf of the tree that a task builds over a cell.
LEAF = 64
#: Leaves of a cell that is not cut any more; with many points a cell holds four times their root, so that cells stay few.
LEAVES = 32
#: Cuts of a grid over the one before, over all features together.
CUTS = 8
#: Grids at most; a cell that still holds more points after these is searched as it is.
GRIDS = 64
#: Queries that meet a cell in one call.
PART = 8192
#: Distances to boxes that are measured at once.
BLOCK = 1 << 20


def robust_scales(df: DataFrame, features: list[str], counts: tuple[str, ...] = (), floor: float = 1e-6) -> dict[str, tuple[float, float]]:
    """``feature: (median, interquartile range)``, from one aggregate; ranges of ``counts`` are 1 at least. A job runs while the plan is built."""
    got = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in features]).first()
    if any(got[c] is None for c in features):
        raise ValueError("no rows to take scales from")
    return {c: (got[c][1], max(got[c][2] - got[c][0], 1.0 if c in counts else floor)) for c in features}


def _square(differences: list[np.ndarray], scales: list[float], weights: list[float]) -> np.ndarray:
    """The sum of weight * (difference / scale)^2; rounding keeps its order, so that a box never seems farther than its points."""
    with np.errstate(over="ignore"):
        out = None
        for d, scale, weight in zip(differences, scales, weights):
            one = (d / scale) * (d / scale) * weight
            out = one if out is None else out + one
    return out


def _finite(df: DataFrame, key: str, features: list[str], *more: Column) -> DataFrame:
    """(id, f0.., more) of rows with a key and finite features; a negative zero is zero."""
    x = [F.col(c).cast("double") for c in features]
    fine = F.col(key).isNotNull()
    for c in x:
        fine = fine & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.where(fine).select(F.col(key).alias("id"), *[(c + F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(x)], *more)


def _index(st: Staging, points: DataFrame, scales: list[float]) -> tuple[dict, DataFrame]:
    """The cells of each class, ``{g: (names, lows, highs)}``, and the points ``(g, cell, id, f0..)`` with the cell they ended in.

    A cell is cut along its own box, so that outliers cost one grid. It is named by a hash of its
    parent and its place there; names that collide only make a box wider.
    """
    k = range(len(scales))
    most = max(LEAVES * LEAF, 4 * math.isqrt(points.count()))
    cuts = max(2, math.floor(CUTS ** (1 / len(scales))))
    edges = [f"{e}{i}" for i in k for e in "ab"]
    box = [f(f"f{i}").alias(f"{e}{i}") for i in k for e, f in (("a", F.min), ("b", F.max))]
    open_ = points.withColumn("cell", F.lit(0).cast("long")).join(F.broadcast(points.groupBy("g").agg(*box)), "g")  # a row for each class
    ends = []
    for level in range(1, GRIDS + 1):
        side = F.greatest(*[(F.col(f"b{i}") - F.col(f"a{i}")) / F.lit(scales[i]) for i in k], F.lit(0.0))  # of a cube in units of the scales
        place = [F.floor(F.coalesce(F.try_divide((F.col(f"f{i}") - F.col(f"a{i}")) / F.lit(scales[i]), side), F.lit(0.0)) * float(cuts)) for i in k]
        named = open_.select("g", "id", *[f"f{i}" for i in k], F.col("cell").alias("parent"), F.xxhash64("cell", *place).alias("cell"))
        leaf = (F.col("n") <= most) if level < GRIDS else F.lit(True)
        grid = st.table(named.groupBy("g", "parent", "cell").agg(*box, F.count(F.lit(1)).alias("n")).select("g", "parent", "cell", *edges, leaf.alias("leaf")))
        kept = st.table(named.join(F.broadcast(grid), ["g", "parent", "cell"]).drop("parent"))  # some thousands of rows
        ends.append(kept.where("leaf").select("g", "cell", "id", *[f"f{i}" for i in k]))
        if grid.where("not leaf").isEmpty():
            break
        open_ = kept.where("not leaf").drop("leaf")
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    cells: dict = {}
    for r in out.groupBy("g", "cell").agg(*box).collect():  # about a thousandth of the points, or the root of their number
        cells.setdefault(r.g, []).append((r.cell, [r[f"a{i}"] for i in k], [r[f"b{i}"] for i in k]))
    return {g: (np.array([c[0] for c in v], np.int64), np.array([c[1] for c in v]), np.array([c[2] for c in v])) for g, v in cells.items()}, out


def _outside(x: np.ndarray, low: np.ndarray, high: np.ndarray, scales: list[float], weights: list[float]) -> np.ndarray:
    """(points, boxes): the squared distance from a point to a box, zero within."""
    return _square([np.maximum(np.maximum(low[:, i] - x[:, i : i + 1], x[:, i : i + 1] - high[:, i]), 0.0) for i in range(x.shape[1])], scales, weights)


def _farthest(x: np.ndarray, low: np.ndarray, high: np.ndarray, scales: list[float], weights: list[float]) -> np.ndarray:
    """(points, boxes): a squared distance within which a box has a point for certain."""
    return _square([np.maximum(x[:, i : i + 1] - low[:, i], high[:, i] - x[:, i : i + 1]) for i in range(x.shape[1])], scales, weights)


def _leaves(p: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of ``p`` in leaves of at most ``size``, halved at the median of the widest feature."""
    todo, out = [np.arange(len(p))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(np.sort(at))
            continue
        half, v = len(at) // 2, p[at]
        order = np.argpartition(v[:, int((v.max(0) - v.min(0)).argmax())], half)
        todo += [at[order[:half]], at[order[half:]]]
    return out


def _runs(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of a sorted array."""
    if len(sorted_):
        cut = np.flatnonzero(np.diff(sorted_)) + 1
        for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(sorted_)].tolist()):
            yield int(sorted_[a]), a, b


def _within(x: np.ndarray, me: np.ndarray, best: np.ndarray, p: np.ndarray, scales: list[float], weights: list[float], leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``p`` or -1, squared distance, measured) for each of ``x``: the nearest row that is not ``me`` and not beyond ``best``, ties to the lesser row."""
    k = range(p.shape[1])
    leaves = _leaves(p / np.array(scales), leaf)
    low, high = np.stack([p[v].min(0) for v in leaves]), np.stack([p[v].max(0) for v in leaves])
    best, at, work = best.copy(), np.full(len(x), -1), np.zeros(len(x), np.int64)

    def measure(rows: np.ndarray, pts: np.ndarray) -> None:
        square = _square([x[rows, i][:, None] - p[pts, i] for i in k], scales, weights)
        square[me[rows][:, None] == pts] = np.inf
        j = square.argmin(1)
        j = np.where(pts[j] == me[rows], (j + 1) % len(pts), j)
        s, r = square[np.arange(len(rows)), j], pts[j]
        better = ((s < best[rows]) | ((s == best[rows]) & ((at[rows] < 0) | (r < at[rows])))) & (r != me[rows])
        best[rows[better]], at[rows[better]] = s[better], r[better]
        work[rows] += len(pts)

    step = max(1, BLOCK // len(leaves))
    for a in range(0, len(x), step):
        near = _outside(x[a : a + step], low, high, scales, weights)
        first = near.argmin(1)
        work[a : a + step] += len(leaves)
        order = np.argsort(first, kind="stable")
        for leaf_, b, c in _runs(first[order]):
            rows = order[b:c]
            rows = rows[near[rows, leaf_] <= best[a + rows]]
            if len(rows):
                measure(a + rows, leaves[leaf_])
        may = near <= best[a : a + step, None]
        may[np.arange(len(first)), first] = False
        which, rows = np.nonzero(may.T)
        for leaf_, b, c in _runs(which):
            still = rows[b:c]
            still = still[near[still, leaf_] <= best[a + still]]
            if len(still):
                measure(a + still, leaves[leaf_])
    return at, best, work


def _features(t: pa.RecordBatch | pa.Table, n: int) -> np.ndarray:
    return np.stack([t.column(f"f{i}").to_numpy() for i in range(n)], 1)


def _search(st: Staging, queries: DataFrame, cells: dict, ends: DataFrame, scales: list[float], weights: list[float]) -> DataFrame:
    """(g, q, nearest, square, compared) for ``queries(g, q, f0.., self)``; a point named ``self`` is passed over."""
    n = len(scales)
    mine = ["g", "q", *[f"f{i}" for i in range(n)], "self"]
    leaf = LEAF
    asks = T.StructType([*queries.select(*mine).schema.fields, *T.StructType.fromDDL("best double, cell long, compared long").fields])
    told = T.StructType([*queries.select(*mine).schema.fields, T.StructField("nearest", ends.schema["id"].dataType), *T.StructType.fromDDL("square double, home long, compared long").fields])

    def of_class(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
        """Rows of a batch by class, with their features and the class's cells."""
        g, x = b.column("g"), _features(b, n)
        for kind, known in cells.items():
            rows = np.flatnonzero(pc.equal(g, pa.scalar(kind, g.type)).to_numpy(zero_copy_only=False))
            step = max(1, BLOCK // len(known[0]))
            for a in range(0, len(rows), step):
                yield rows[a : a + step], x[rows[a : a + step]], known

    def asked(b: pa.RecordBatch, rows: np.ndarray, best: np.ndarray, cell: np.ndarray, compared: int) -> pa.RecordBatch:
        kept = b.select(mine).take(pa.array(rows))
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(best, pa.float64()), pa.array(cell, pa.int64()), pa.array(np.full(len(rows), compared), pa.int64())], names=asks.names)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x, (names, low, high) in of_class(b):
                yield asked(b, rows, np.full(len(rows), np.inf), names[_outside(x, low, high, scales, weights).argmin(1)], len(names))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            square, at = b.column("square").to_numpy(), b.column("home").to_numpy()
            for rows, x, (names, low, high) in of_class(b):
                elsewhere = names != at[rows][:, None]
                # a home that holds the query alone tells nothing, but every other cell holds something
                sure = np.where(elsewhere, _farthest(x, low, high, scales, weights), np.inf).min(1)
                best = np.minimum(square[rows], sure)
                i, c = np.nonzero((_outside(x, low, high, scales, weights) <= best[:, None]) & elsewhere)
                for a in range(0, len(i), BLOCK):
                    yield asked(b, rows[i[a : a + BLOCK]], best[i[a : a + BLOCK]], names[c[a : a + BLOCK]], 0)

    def visit(asking: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by("id")
        ids = points.column("id").combine_chunks()
        me = pc.fill_null(pc.index_in(asking.column("self"), ids), -1).to_numpy()
        if not len(me) or not len(ids):
            at, best, work = np.full(len(me), -1), np.full(len(me), np.inf), np.zeros(len(me), np.int64)
        else:
            at, best, work = _within(_features(asking, n), me, asking.column("best").to_numpy(), _features(points, n), scales, weights, leaf)
        found = ids.take(pa.array(at, mask=at < 0))
        square = np.where(at < 0, np.inf, best)
        return pa.table([*asking.select(mine).columns, found, pa.array(square), asking.column("cell"), pa.array(asking.column("compared").to_numpy() + work)], names=told.names)

    def met(asking: DataFrame) -> DataFrame:
        parts = asking.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))  # a row for each cell
        left = asking.join(F.broadcast(parts), ["g", "cell"]).withColumn("part", F.pmod(F.xxhash64("q"), "parts")).select(*asks.names, "part")
        right = ends.join(F.broadcast(parts), ["g", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        by = ["g", "cell", "part"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(visit, told)

    at_home = st.table(met(st.table(queries.select(*mine).mapInArrow(home, asks))))
    further = met(st.table(at_home.select(*mine, "square", "home").mapInArrow(others, asks)))
    both = at_home.select("g", "q", "nearest", "square", "compared").union(further.select("g", "q", "nearest", "square", "compared"))
    best = both.groupBy("g", "q").agg(F.min(F.when(F.col("nearest").isNotNull(), F.struct("square", "nearest"))).alias("x"), F.sum("compared").alias("compared"))
    return best.where("x is not null").select("g", "q", "x.nearest", "x.square", "compared")


def nearest(queries: DataFrame, reference: DataFrame, key: str, features: list[str], scales: dict[str, float], by: str, weights: dict[str, float] | None = None, among_itself: bool = False) -> DataFrame:
    """``(key, class, nearest, distance, compared)``: the nearest reference row of every class for each query, ties to the lesser id.

    The distance is the root of the sum of weight * (difference / scale)^2. ``compared`` counts the boxes
    and points that were measured for it. ``by`` names the reference's class column; with ``among_itself`` queries are the
    reference's own rows, each looked up among the others of its class (another id, that is; a class of one row has no answer). Rows
    without a key or with a feature that is null or not finite take no part, nor do reference rows without a class. Repeated rows
    of ``queries`` are each answered; empty tables give no rows. Classes are few: their names go to the driver.
    """
    names = [f"f{i}" for i in range(len(features))]
    s, w = [float(scales[c]) for c in features], [float((weights or {}).get(c, 1.0)) for c in features]
    with Staging(reference.sparkSession, "nearest") as st:
        rows = st.table(_finite(reference, key, features, F.col(by).alias("g")).where("g is not null"))
        least = st.table(rows.groupBy("g", *names).agg(F.min("id").alias("id"), F.max("id").alias("last")))
        cells, ends = _index(st, least.select("g", "id", *names), s) if not least.isEmpty() else ({}, None)
        kinds = list(cells)
        schema = f"`{key}` {dict(reference.dtypes)[key]}, class {dict(reference.dtypes)[by]}, nearest {dict(reference.dtypes)[key]}, distance double, compared long"
        if not kinds:
            return reference.sparkSession.createDataFrame([], schema)
        if among_itself:
            # copies under several ids have each other
            alone = least.where(F.col("id") == F.col("last"))
            found = _search(st, alone.select("g", F.col("id").alias("q"), *names, F.col("id").alias("self")), cells, ends, s, w)
            told = found.select(F.col("q").alias("id"), "g", "nearest", "square", "compared")
            one = st.table(rows.join(told, ["g", "id"])).select("id", "g", "nearest", "square", "compared")
            twins = least.where(F.col("id") != F.col("last")).withColumnRenamed("id", "_least")
            copies = rows.join(twins, ["g", *names])
            second = copies.where(F.col("id") != F.col("_least")).groupBy("g", *names).agg(F.min("id").alias("_second"))
            both = copies.join(second, ["g", *names]).select("id", "g", F.when(F.col("id") == F.col("_least"), F.col("_second")).otherwise(F.col("_least")).alias("nearest"), F.lit(0.0).alias("square"), F.lit(0).cast("long").alias("compared"))
            out = one.union(both)
        else:
            asked = st.table(_finite(queries, key, features))
            points = asked.groupBy(*names).agg(F.min("id").alias("q"))
            points = st.table(points)
            every = points.withColumn("g", F.explode(F.array(*map(F.lit, kinds)))).withColumn("self", F.lit(None).cast(reference.schema[key].dataType))
            found = _search(st, every, cells, ends, s, w)
            named = asked.join(points, names).select("id", "q")
            out = named.join(found, "q").select("id", "g", "nearest", "square", "compared")
        return st.keep(out.select(F.col("id").alias(key), F.col("g").alias("class"), "nearest", F.sqrt("square").alias("distance"), "compared"))


def exact_quantile(df: DataFrame, group: list[str], value: str, q: float, slack: float = 0.002) -> DataFrame:
    """``(group, n, quantile)``, interpolated between neighbours, without gathering a group.

    An approximate quantile on either side brackets the two rows that count; only rows between are ranked, about ``2 * slack`` of a group
    and the copies of its ends. The bracket is wider than the approximation's error. Nulls are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", F.array(F.lit(max(0.0, q - slack)), F.lit(min(1.0, q + slack))), F.lit(round(4 / slack))).alias("_e"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    low, high = (F.col("_min") if q <= slack else F.col("_e")[0]), (F.col("_max") if q >= 1 - slack else F.col("_e")[1])
    at = F.lit(q) * (F.col("n") - 1)
    # few rows: the bracket takes all of them
    small = F.col("n") * slack < 2
    ends = ends.select(*group, "n", F.when(small, F.col("_min")).otherwise(low).alias("_low"), F.when(small, F.col("_max")).otherwise(high).alias("_high"), at.alias("_at"))
    near = rows.join(F.broadcast(ends), group)  # a row for each group
    under = near.groupBy(*group).agg(F.count_if(F.col("_v") < F.col("_low")).alias("_under"))
    values = near.where(F.col("_v").between(F.col("_low"), F.col("_high"))).groupBy(*group, "n", "_at", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_v")) + F.col("_under")
    ranked = values.join(under, group).withColumn("_to", upto)
    whole = F.floor("_at")
    hit = lambda i: F.min(F.when(F.col("_to") > i, F.col("_v")))
    told = ranked.groupBy(*group, "n", "_at").agg(hit(whole).alias("_a"), hit(F.least(whole + 1, F.col("n") - 1)).alias("_b"))
    return told.select(*group, "n", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias("quantile"))


def exact_quantiles(df: DataFrame, value: str, qs: list[float], slack: float = 0.002) -> list[float]:
    """Quantiles of a whole column, interpolated between neighbours; none without values. As ``exact_quantile``, for several at once: only rows in a bracket are ranked, each bracket by itself."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    at = [F.lit(x) for q in qs for x in (max(0.0, q - slack), min(1.0, q + slack))]
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", F.array(*at), F.lit(round(4 / slack))).alias("e"), F.min("_v").alias("a"), F.max("_v").alias("b")).first()
    if not got.n:
        return []
    small = got.n * slack < 2  # few rows: a bracket takes all of them
    ends = [(got.a if small or q <= slack else got.e[2 * i], got.b if small or q >= 1 - slack else got.e[2 * i + 1]) for i, q in enumerate(qs)]
    inside = [F.col("_v").between(F.lit(a), F.lit(b)) for a, b in ends]
    under = rows.agg(*[F.count_if(F.col("_v") < F.lit(a)).alias(f"u{i}") for i, (a, _) in enumerate(ends)]).first()
    some = inside[0]
    for c in inside[1:]:
        some = some | c
    counts = rows.where(some).groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    each = counts.select("_v", "_c", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)]))).alias("i"))
    low = [math.floor(q * (got.n - 1)) for q in qs]
    wanted = lambda ks: F.element_at(F.array(*[F.lit(k - under[f"u{i}"]) for i, k in enumerate(ks)]), F.col("i") + 1)
    upto = F.sum("_c").over(Window.partitionBy("i").orderBy("_v"))
    hit = lambda ks: F.min(F.when(F.col("_to") > wanted(ks), F.col("_v")))
    told = {r.i: (r.a, r.b) for r in each.withColumn("_to", upto).groupBy("i").agg(hit(low).alias("a"), hit([min(k + 1, got.n - 1) for k in low]).alias("b")).collect()}
    share = [q * (got.n - 1) - k for q, k in zip(qs, low)]
    return [a if f == 0 or a == b else (1 - f) * a + f * b for f, (a, b) in zip(share, (told[i] for i in range(len(qs))))]


def thresholds(reference: DataFrame, key: str, features: list[str], scales: dict[str, float], by: str, weights: dict[str, float] | None = None, q: float = 0.95) -> DataFrame:
    """``(class, n, threshold)``: the ``q`` quantile of each reference row's distance to the nearest other row of its class."""
    own = nearest(reference, reference, key, features, scales, by, weights, among_itself=True)
    return exact_quantile(own, ["class"], "distance", q).withColumnRenamed("quantile", "threshold")


def coverage(distances: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """``(key, class, nearest, distance, threshold, covered)``: each query's nearest row by class, and whether it lies within the class's threshold."""
    told = distances.join(F.broadcast(limits.select("class", "threshold")), "class")  # a row for each class
    return told.select(key, "class", "nearest", "distance", "threshold", (F.col("distance") <= F.col("threshold")).alias("covered"))


def coverage_rates(covered: DataFrame, key: str) -> DataFrame:
    """``(kind, n, rate)``: the share of queries within each class, each two of them, any, none and all, from one row a set of classes."""
    kinds = sorted(r["class"] for r in covered.select("class").distinct().collect())
    if not kinds:
        return covered.sparkSession.createDataFrame([], "kind string, n long, rate double")
    sets = covered.groupBy(key).agg(*[F.max(F.when(F.col("class") == k, F.col("covered"))).alias(f"_{i}") for i, k in enumerate(kinds)])
    flags = {str(k): F.coalesce(F.col(f"_{i}"), F.lit(False)) for i, k in enumerate(kinds)}
    from .populations import membership_rates

    n = sets.agg(F.count(F.lit(1)).alias("n"))
    return membership_rates(sets, [], flags).join(F.broadcast(n)).select("kind", "n", "rate")


def telling_cases(covered: DataFrame, key: str) -> DataFrame:
    """``(class, role, key, nearest, distance)``: of each class the covered query nearest to the median of those, the last one covered and the first one not. Ties (to nine digits about the median) go to the lesser key."""
    inside = covered.where("covered").groupBy("class")
    middle = exact_quantile(covered.where("covered"), ["class"], "distance", 0.5).select("class", F.col("quantile").alias("_m"))
    one = F.struct(F.col(key).alias("k"), "nearest", "distance")
    first = covered.where("covered").join(F.broadcast(middle), "class").groupBy("class").agg(F.min_by(one, F.struct(F.round(F.abs(F.col("distance") - F.col("_m")), 9), F.col(key))).alias("x"), F.lit("inside").alias("role"))
    last = inside.agg(F.min_by(one, F.struct(-F.col("distance"), F.col(key))).alias("x"), F.lit("boundary").alias("role"))
    out = covered.where("not covered").groupBy("class").agg(F.min_by(one, F.struct("distance", F.col(key))).alias("x"), F.lit("outside").alias("role"))
    return first.union(last).union(out).select("class", "role", F.col("x.k").alias(key), "x.nearest", "x.distance")
