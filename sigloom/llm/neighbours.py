"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts by repeated
bisection; each half-and-half split is refined by swapping the pairs of vectors
that save most edges. A small network learns which part a vector's neighbours
lie in. From ``PART * FAN`` rows on, each part is cut again in the same way, by a
network of its own. A row is kept in the leaf it finds most probable; a query goes
to its several most probable leaves, whose rows are compared exactly. How many that
takes is not guessed: a bounded set of queries is answered by brute force first,
the least number is taken that finds ``RECALL`` of its true neighbours, and what the
search then found for these queries is measured against the same truth.

Leaves are dealt in blocks of rows: several to a block, or, for one that holds a third
of all rows, several blocks to a leaf. A query goes once to each block that has
a leaf of its choice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import brute_force, lengths, matrix, nearest, sample, unit, valid_vectors
from .work import Workspace

K, EVERY = 5, 50
SAMPLE, DEGREE, AUDIT = 8192, 10, 256
#: Rows for each leaf while one level is enough, parts of a level, and rows each part of the second is learned from.
PART, FAN, FINE_SAMPLE = 64, 64, 2048
#: Rows and queries that meet in a task; lengths of vectors that get an index of their own, others are compared whole.
BLOCK, QUERIES, INDEXED = 4096, 8192, 4
RECALL, LEAST_RECALL = 0.96, 0.9
HIDDEN, FINE_HIDDEN, EPOCHS = 96, 48, 12


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """(n, degree): each row's nearest other rows."""
    out = np.empty((len(x), min(degree, len(x) - 1)), np.int64)
    x = x.astype(np.float32)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def bisect(x: np.ndarray, edges: np.ndarray, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Split rows in two halves of equal size (odd: one more) with few edges (a, b) between them."""
    n = len(x)
    centred = x - x.mean(0)
    direction = rng.standard_normal(x.shape[1])
    for _ in range(6):  # the main direction, by power iteration
        direction = centred.T @ (centred @ direction)
        direction /= max(np.linalg.norm(direction), 1e-30)
    side = np.zeros(n, bool)
    side[np.argsort(centred @ direction, kind="stable")[n // 2 :]] = True
    a, b = edges.T
    for _ in range(rounds):
        across = np.where(side[a] != side[b], 1, -1)
        gain = np.bincount(a, across, n) + np.bincount(b, across, n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        good = int((gain[left[:m]] + gain[right[:m]] > 0).sum()) // 2  # half of them: swapped neighbours undo each other
        if not good:
            break
        side[left[:good]], side[right[:good]] = True, False
    return side


def partition_graph(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Balanced labels 0..parts-1 (a power of two) by recursive bisection of the graph."""
    rng = np.random.default_rng(seed)
    label = np.zeros(len(x), np.int64)
    edges = np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], 1)
    while parts > 1:
        new = label * 2
        inner = edges[label[edges[:, 0]] == label[edges[:, 1]]]
        for p in np.unique(label):
            rows = np.flatnonzero(label == p)
            back = np.full(len(x), -1)
            back[rows] = np.arange(len(rows))
            own = back[inner[label[inner[:, 0]] == p]]
            new[rows] += bisect(x[rows], own, rng)
        label, parts = new, parts // 2
    return label


class Router:
    """One hidden layer from a unit vector to the parts' probabilities."""

    def __init__(self, dims: int, parts: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = [rng.standard_normal((dims, hidden)) * (2 / dims) ** 0.5 * 2, rng.standard_normal((hidden, parts)) * hidden**-0.5]
        self.b = [np.zeros(hidden), np.zeros(parts)]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w[0] + self.b[0], 0) @ self.w[1] + self.b[1]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, rate: float = 0.004, seed: int = 3) -> Router:
        """Minimise cross-entropy against soft targets by Adam."""
        rng = np.random.default_rng(seed)
        params = [*self.w, *self.b]
        first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                at = order[i : i + 256]
                h = np.maximum(x[at] @ self.w[0] + self.b[0], 0)
                z = h @ self.w[1] + self.b[1]
                p = np.exp(z - z.max(1, keepdims=True))
                d = (p / p.sum(1, keepdims=True) - target[at]) / len(at)
                dh = (d @ self.w[1].T) * (h > 0)
                step += 1
                for q, g, a, b in zip(params, (x[at].T @ dh, h.T @ d, dh.sum(0), d.sum(0)), first, second):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self


def build_router(x: np.ndarray, parts: int, hidden: int = HIDDEN) -> Router:
    """Cut the sample's neighbour graph and learn where neighbours lie."""
    if len(x) < 2 * parts:
        x = np.concatenate([x, np.random.default_rng(1).standard_normal((2 * parts, x.shape[1])) * x.shape[1] ** -0.5])
    graph = neighbour_graph(x, DEGREE)
    label = partition_graph(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 0.5 / graph.shape[1])
    target[np.arange(len(x)), label] += 0.5
    return Router(x.shape[1], parts, hidden).fit(x, target)


class Index:
    """A router, and one for each of its parts where there are two levels: leaves are numbered through."""

    def __init__(self, top: Router | None, below: list[Router] | None = None):
        self.top, self.below = top, below
        self.fine = below[0].b[1].size if below else 1
        self.leaves = (top.b[1].size if top else 1) * self.fine

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf each row is kept in."""
        if self.top is None or not len(x):
            return np.zeros(len(x), np.int64)
        part = self.top.probabilities(x).argmax(1)
        if not self.below:
            return part
        leaf = np.zeros(len(x), np.int64)
        for p in np.unique(part):
            at = part == p
            leaf[at] = p * self.fine + self.below[p].probabilities(x[at]).argmax(1)
        return leaf

    def order(self, x: np.ndarray) -> np.ndarray:
        """(rows, leaves): leaves in which a row's neighbours lie, the most probable first."""
        if self.top is None or not len(x):
            return np.zeros((len(x), 1), np.int64)
        p = self.top.probabilities(x)
        if self.below:
            p = np.stack([p[:, i, None] * r.probabilities(x) for i, r in enumerate(self.below)], 1).reshape(len(x), -1)
        return np.argsort(-p, axis=1, kind="stable")


def leaves_for(total: int) -> int:
    """A power of two: a leaf for every ``PART`` rows at first, then as many as the root of the rows, ``FAN`` squared at most."""
    want = total / PART if total <= PART * FAN else max(FAN, total**0.5)
    return int(min(FAN * FAN, 2 ** max(0, round(np.log2(max(1.0, want))))))


def build_index(ws: Workspace, rows: DataFrame, total: int) -> Index:
    """Learn the partition of ``rows(vec_id, vec)`` from bounded samples; the second level's parts are learned in one task each."""
    leaves = leaves_for(total)
    if leaves == 1:
        return Index(None)
    top = build_router(unit(sample(rows, SAMPLE, total, "fit")[1]), min(FAN, leaves))
    if leaves <= FAN:
        return Index(top)
    fine, shared = leaves // FAN, rows.sparkSession.sparkContext.broadcast(top)
    draw = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit("fine")), 11) / float(1 << 53)

    def parts_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(Index(shared.value).home(unit(matrix(b.column(0)))), pa.int32())], names=["part"])

    sizes = {r.part: r.n for r in rows.select("vec").mapInArrow(parts_of, "part int").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = np.array([FINE_SAMPLE / max(1, sizes.get(p, 0)) for p in range(FAN)])

    def drawn(batches):
        for b in batches:
            p = Index(shared.value).home(unit(matrix(b.column(0))))
            keep = pa.array(b.column(1).to_numpy() < rate[p])
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), b.column(0)], names=["part", "vec"]).filter(keep)

    def learn(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        r = build_router(unit(matrix(group.column("vec"))), fine, FINE_HIDDEN)
        flat = np.concatenate([w.ravel() for w in (*r.w, *r.b)]).astype(np.float32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([flat.tobytes()], pa.binary())})

    # about FINE_SAMPLE rows of each part, however many it has
    some = rows.select("vec", draw.alias("draw")).mapInArrow(drawn, "part int, vec array<double>")
    got = {r.part: np.frombuffer(r.weights, np.float32).astype(np.float64) for r in some.groupBy("part").applyInArrow(learn, "part int, weights binary").collect()}
    dims = top.w[0].shape[0]
    below = []
    for p in range(FAN):
        r = Router(dims, fine, FINE_HIDDEN)
        if p in got:
            at = 0
            for w in (*r.w, *r.b):
                w[...] = got[p][at : at + w.size].reshape(w.shape)
                at += w.size
        below.append(r)
    return Index(top, below)


_DEALT = "block long, asks boolean, leaf int, leaves array<int>, vec_id long, vec array<double>"
_FOUND = "query_id long, vec_id long, score double"


def _compare(k: int):
    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        ids, m, leaf = group.column("vec_id").to_numpy(), unit(matrix(group.column("vec"))), group.column("leaf").to_numpy()
        a, v, s = [], [], []
        if asks.any() and not asks.all():
            low, width = leaf[~asks].min(), int(np.ptp(leaf[~asks])) + 1
            wanted = group.column("leaves").combine_chunks().filter(pa.array(asks))
            allowed = np.zeros((int(asks.sum()), width), bool)
            flat = wanted.flatten().to_numpy() - low
            owner = np.repeat(np.arange(len(allowed)), wanted.value_lengths().to_numpy())
            inside = (flat >= 0) & (flat < width)
            allowed[owner[inside], flat[inside]] = True
            a, v, s = nearest(m[asks], ids[asks], m[~asks], ids[~asks], k, allowed, leaf[~asks] - low)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def _found(ws: Workspace, rows: DataFrame, index: Index, sizes: np.ndarray, probes: int, k: int, every: int) -> DataFrame:
    """Candidates (query_id, vec_id, score): the k best of each query in each block it is sent to."""
    # consecutive small leaves share a block, a large one has several; numbers in proportion to the leaves
    first, blocks, room = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // BLOCK)), 0
    at = -1
    for i, n in enumerate(sizes.tolist()):
        if n > room:
            at, room = at + 1, max(0, BLOCK - n)
            first[i] = at
            at += int(blocks[i]) - 1
        else:
            first[i], room = at, room - n
    shared = rows.sparkSession.sparkContext.broadcast((index, first, blocks))

    def deal(batches):
        index, first, blocks = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), unit(matrix(b.column(1)))
            leaf = index.home(x)
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = first[leaf] + (mixed % blocks[leaf].astype(np.uint64)).astype(np.int64)
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(ids) + 1, np.int32)), pa.array([], pa.int32()))
            names = ["block", "asks", "leaf", "leaves", "vec_id", "vec"]
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.zeros(len(ids), bool)), pa.array(leaf.astype(np.int32)), none, b.column(0), b.column(1)], names=names)
            asking = np.flatnonzero(ids % every == 0)
            for i in range(0, len(asking), 256):
                q = asking[i : i + 256]
                sought = index.order(x[q])[:, :probes]
                n = blocks[sought].ravel()
                row = np.repeat(np.repeat(np.arange(len(q)), sought.shape[1]), n)
                to = np.repeat(first[sought].ravel(), n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                what = np.repeat(sought.ravel(), n)
                order = np.lexsort((what, to, row))
                row, to, what = row[order], to[order], what[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (to[1:] != to[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)].astype(np.int32)), pa.array(what.astype(np.int32)))
                who = pa.array(q[row[new]])
                yield pa.RecordBatch.from_arrays([pa.array(to[new]), pa.array(np.ones(len(new), bool)), pa.array(np.zeros(len(new), np.int32)), lists, b.column(0).take(who), b.column(1).take(who)], names=names)

    dealt = ws.table(rows.select("vec_id", "vec").mapInArrow(deal, _DEALT))
    groups = dealt.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("asks").cast("int")) / QUERIES).cast("int")).alias("groups")).where("groups > 1")
    told = dealt.join(groups, "block", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int"))
    told = told.withColumn("group", F.explode(F.when(F.col("asks"), own).otherwise(F.sequence(F.lit(0), F.col("groups") - 1)))).drop("groups")
    return told.groupBy("block", "group").applyInArrow(_compare(k), _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(ws: Workspace, rows: DataFrame, total: int, k: int, every: int) -> DataFrame:
    """The search over vectors of one length."""
    index = build_index(ws, rows, total)
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def leaf(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.home(unit(matrix(b.column(1)))), pa.int64())], names=["vec_id", "leaf"])

    homes = ws.table(rows.select("vec_id", "vec").mapInArrow(leaf, "vec_id long, leaf long"))
    sizes = np.zeros(index.leaves, np.int64)
    for r in homes.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each leaf, FAN squared at most
        sizes[r.leaf] = r.n
    queries = rows.where(F.col("vec_id") % every == 0)
    ids, q = sample(queries, AUDIT, queries.count(), "audit")
    truth = brute_force(rows, ids, q, k) if len(ids) else {}
    wanted = sorted({v for r in truth.values() for v, _ in r})  # k for each audited query at most
    order = index.order(unit(q)) if len(ids) else np.zeros((0, index.leaves), np.int64)
    probes = index.leaves
    if wanted:
        at_home = {r.vec_id: r.leaf for r in homes.where(F.col("vec_id").isin(wanted)).collect()}
        at = np.array([int(np.flatnonzero(order[i] == at_home[v])[0]) for i, one in enumerate(ids.tolist()) for v, _ in truth[one]])
        probes = int(np.searchsorted(np.cumsum(np.bincount(at, minlength=index.leaves)) / len(at), RECALL) + 1)
    pairs = sum(map(len, truth.values()))
    while True:
        top = ws.table(_top(_found(ws, rows, index, sizes, probes, k, every), k))
        got: dict[int, set[int]] = {}
        for r in top.where(F.col("query_id").isin([int(i) for i in ids])).collect() if pairs else []:
            got.setdefault(r.query_id, set()).add(r.vec_id)
        recall = sum(v in got.get(i, ()) for i, one in truth.items() for v, _ in one) / pairs if pairs else None
        if recall is None or recall >= LEAST_RECALL or probes >= index.leaves:
            break
        probes = min(index.leaves, 2 * probes)
    compared = float(sizes[order[:, :probes]].sum(1).mean() / total) if len(order) else None
    return top.select("*", F.lit(probes).alias("parts"), F.lit(index.leaves).alias("of_parts"), F.lit(compared).cast("double").alias("compared"), F.lit(recall).cast("double").alias("recall"))


def _whole(rows: DataFrame, k: int, every: int) -> DataFrame:
    """Every query against all rows of its length, in blocks: for lengths that few vectors have."""
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    told = rows.withColumn("d", F.size("vec")).join(sizes, "d").withColumn("n", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    asks = F.col("vec_id") % every == 0
    kept = told.select("d", "n", F.lit(False).alias("asks"), F.lit(0).alias("leaf"), F.array().cast("array<int>").alias("leaves"), "vec_id", "vec")
    sent = told.where(asks).select("d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("n"), F.lit(True).alias("asks"), F.lit(0).alias("leaf"), F.array(F.lit(0)).alias("leaves"), "vec_id", "vec")
    return _top(kept.union(sent).groupBy("d", "n").applyInArrow(_compare(k), _FOUND), k)


def search(table: DataFrame, column: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """``(query_id, rank, vec_id, score, parts, of_parts, compared, recall)``: the k nearest rows found for each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all
    other rows of the same length. score is the cosine in double precision; ties go to
    the smaller vec_id. A query with fewer than k candidates gets them all. ``parts`` says
    in how many leaves ``of_parts`` it was sought, ``compared`` what share of all rows an
    audited query met and ``recall`` what share of their true neighbours it found; both are null
    where nothing was audited. The ``INDEXED`` most frequent lengths have an index, vectors of other
    lengths are compared whole. Rows that can't be compared take no part; of repeated
    ids one does. Extra columns are ignored; an empty table gives no rows.
    """
    ws = Workspace(table.sparkSession, "neighbours")
    rows = ws.table(valid_vectors(table, column))
    sizes = lengths(rows)
    out = []
    for d in list(sizes)[:INDEXED]:
        out.append(_search(ws, rows.where(F.size("vec") == d) if len(sizes) > 1 else rows, sizes[d], k, every))
    if len(sizes) > INDEXED or not sizes:
        rest = _whole(rows.where(~F.size("vec").isin(list(sizes)[:INDEXED])), k, every)
        out.append(rest.select("*", F.lit(1).alias("parts"), F.lit(1).alias("of_parts"), F.lit(1.0).alias("compared"), F.lit(None).cast("double").alias("recall")))
    done = out[0]
    for o in out[1:]:
        done = done.union(o)
    return done


def op1_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
