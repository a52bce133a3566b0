"""Near-duplicate vectors through a robust-pruned flat graph.

Equal vectors are one class first. Classes are dealt to their nearest k-means
clusters, several each, so that shards overlap; there are as many clusters as the
rows need, on two levels if they are many. Each shard's graph is built by inserting its rows:
a greedy search from the medoid over the graph so far finds candidates, which are
pruned robustly (a neighbour goes if a kept one is closer to it, by a factor, than the
row is); reverses are added and pruned alike. The adjacency lists of all shards are
united by row into one flat graph, a table. On that graph every row is sought by greedy
search from the medoid of each of its shards, and from what lies within the range, and from the
row itself, the search widens along edges; where edges lead out of the shard, the rows at
their ends are joined and met with those the shard has linked. What is found within range
are the links, verified by their cosine in double precision. Only links that join
components are kept, never all pairs, and components cross from shard to shard.
Within a component every link is then counted: rows within half the range's angle of the
component's first row are linked with each other for certain, by the triangle
inequality, and are counted at once; all others meet the whole component in blocks.

The links of a bounded set of rows are audited by brute force: rows drawn at random, rows that
have links, and of those without the ones whose nearest neighbour in the graph is most alike,
where a link is missing if one is anywhere. Recall is a mean
over audited rows, once for rows with few links and once for those with many, and the
lesser of the two counts, so that a large group does not speak for small ones. While it
is short of ``RECALL``, the shards overlap more and the graph gets denser; only when
no level reaches it, all rows are compared block by block. Without an audited row that has a
link, the graph's answer stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .vectors import lengths, matrix, sample, unit, valid_vectors
from .work import Workspace

COSINE = 0.9
#: Rows clusters are learned from, rows of a shard, clusters of a level, and rows of one the next level is learned from.
SAMPLE, SHARD, CLUSTERS, FINE_SAMPLE = 16384, 1024, 1024, 4096
OVERLAPS, DEGREES = (2, 4, 8), (16, 24, 48)
#: The most rows of a shard's graph as a multiple of SHARD and the overlap (larger shards are dealt in parts, otherwise in each shard); rows of a piece; rows of the exact pass.
LARGEST, PIECE, BLOCK = 4, 2048, 4096
#: The pruning factor, the beams of building and searching.
ALPHA, BUILD, BEAM = 1.2, 20, 6
#: Rows audited: drawn at random, with links, and near the range without any. A row has few links up to so many.
AUDITS, FEW = (256, 1024, 1024), 32
RECALL = 0.995
#: Lengths of vectors that have a graph of their own; vectors of others are compared block by block.
INDEXED = 4


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 13) -> np.ndarray:
    """Unit centroids of unit rows; empty clusters keep their last centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, best, x)
        size = np.sqrt((sums * sums).sum(1))
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    return c


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, rows: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy searches for ``rows`` of x over lists (n, width; -1 is no neighbour): beams' rows and similarities, then those expanded."""
    width = max(16, (1 << 23) // max(1, graph.shape[1] * x.shape[1]))
    if len(rows) > width:  # bounded memory, whatever the lists' width
        some = [beam_search(x, graph, start, rows[i : i + width], beam) for i in range(0, len(rows), width)]
        most = max(s[2].shape[1] for s in some)
        fill = lambda v, by: np.pad(v, ((0, 0), (0, most - v.shape[1])), constant_values=by)
        return tuple(np.concatenate(v) for v in zip(*[(s[0], s[1], fill(s[2], -1), fill(s[3], -np.inf)) for s in some]))  # type: ignore[return-value]
    m, q = len(rows), x[rows]
    ids, sims, open_ = np.full((m, beam), -1), np.full((m, beam), -np.inf, x.dtype), np.zeros((m, beam), bool)
    ids[:, 0], sims[:, 0], open_[:, 0] = start, q @ x[start], True
    seen_ids, seen_sims = [], []
    for _ in range(4 * beam + 32):
        score = np.where(open_, sims, -np.inf)
        at = score.argmax(1)
        go = np.flatnonzero(score[np.arange(m), at] > -np.inf)
        if not len(go):
            break
        node = ids[go, at[go]]
        seen_ids.append(np.full(m, -1))
        seen_sims.append(np.full(m, -np.inf, x.dtype))
        seen_ids[-1][go], seen_sims[-1][go] = node, sims[go, at[go]]
        open_[go, at[go]] = False
        near = graph[node]
        value = np.einsum("gwd,gd->gw", x[near], q[go])
        value[near < 0] = -np.inf
        step, val = np.concatenate([ids[go], near], 1), np.concatenate([sims[go], value], 1)
        fresh = np.concatenate([open_[go], near >= 0], 1)
        order = np.argsort(2 * step + fresh, axis=1, kind="stable")  # of equal rows the expanded one stands first
        step, val, fresh = (np.take_along_axis(v, order, 1) for v in (step, val, fresh))
        val[:, 1:][step[:, 1:] == step[:, :-1]] = -np.inf
        keep = np.argpartition(-val, beam - 1, axis=1)[:, :beam]
        ids[go], sims[go] = np.take_along_axis(step, keep, 1), np.take_along_axis(val, keep, 1)
        open_[go] = np.take_along_axis(fresh, keep, 1) & (sims[go] > -np.inf)
    return ids, sims, np.stack(seen_ids, 1), np.stack(seen_sims, 1)


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """(rows, degree): of each row's candidates those that no kept one, nearer to them by a factor, stands for; -1 where there are fewer."""
    sims = np.where((cand < 0) | (cand == own[:, None]), -np.inf, sims)
    order = np.argsort(2 * cand, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    sims[:, 1:][cand[:, 1:] == cand[:, :-1]] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    out = np.full((len(own), degree), -1)
    width = max(1, (1 << 22) // max(1, cand.shape[1] * x.shape[1]))
    for i in range(0, len(own), width):
        c, far = cand[i : i + width], 1 - sims[i : i + width]
        alive, vec, rows = np.isfinite(far), x[c], np.arange(len(c))
        for k in range(degree):
            some = np.flatnonzero(alive.any(1))
            if not len(some):
                break
            first = alive[some].argmax(1)
            pick = c[some, first]
            out[i + some, k] = pick
            alive[some, first] = False
            between = 1 - np.einsum("scd,sd->sc", vec[some], x[pick])
            alive[some] &= alpha * between > far[some]
        del rows
    return out


def build_graph(x: np.ndarray, degree: int, beam: int = BUILD, seed: int = 3) -> tuple[np.ndarray, int]:
    """(n, degree) lists and the medoid: rows are inserted in batches, each as large as what stands; then all once more."""
    n = len(x)
    graph = np.full((n, degree), -1)
    medoid = int((x @ x.mean(0)).argmax()) if n else 0
    order = np.random.default_rng(seed).permutation(n)
    order = np.r_[medoid, order[order != medoid]]
    for again in (False, True):
        at = 0 if again else 1
        while at < n:
            batch = order[at : at + (512 if again else min(at, 512))]
            at += len(batch)
            ids, sims, more, values = beam_search(x, graph, medoid, batch, beam)
            old = graph[batch]
            known = np.where(old < 0, -np.inf, np.einsum("bwd,bd->bw", x[old], x[batch]))
            graph[batch] = robust_prune(x, batch, np.concatenate([ids, more, old], 1), np.concatenate([sims, values, known], 1), degree)
            to, source = graph[batch].ravel(), np.repeat(batch, degree)
            to, source = to[to >= 0], source[graph[batch].ravel() >= 0]
            order_ = np.lexsort((-(x[to] * x[source]).sum(1), to))
            to, source = to[order_], source[order_]
            nth = np.arange(len(to)) - np.searchsorted(to, to)
            to, source, nth = to[nth < degree], source[nth < degree], nth[nth < degree]
            target, where = np.unique(to, return_inverse=True)
            news = np.full((len(target), degree), -1)
            news[where, nth] = source
            both = np.concatenate([graph[target], news], 1)
            graph[target] = robust_prune(x, target, both, np.einsum("bwd,bd->bw", x[both], x[target]), degree)
    return graph, medoid


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that links reach, for each of n rows."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def range_search(x: np.ndarray, graph: np.ndarray, medoid: int, cosine: float, beam: int = BEAM) -> np.ndarray:
    """A label for each row: the least row that links within the range reach, as far as searches over ``graph`` find them.

    Greedy searches from the medoid end in each row's surroundings; from those within its range,
    and from the row, the search widens along edges to rows of other components.
    """
    n = len(x)
    if n < 2:
        return np.arange(n)
    ids, sims, _, _ = beam_search(x, graph, medoid, np.arange(n), min(beam, n))
    q, i = np.nonzero((sims >= cosine) & (ids != np.arange(n)[:, None]) & (ids >= 0))
    a, b = [q], [ids[q, i]]
    q, i = np.nonzero(graph >= 0)
    v = graph[q, i]
    near = np.concatenate([(x[q[j : j + 65536]] * x[v[j : j + 65536]]).sum(1) for j in range(0, len(q), 65536)] or [np.empty(0)]) >= cosine
    a, b = np.concatenate([*a, q[near], v[near]]), np.concatenate([*b, v[near], q[near]])
    label = _labels(n, a, b)
    while len(a):
        fresh = []
        for j in range(0, len(a), 1 << 14):
            who, to = np.repeat(a[j : j + (1 << 14)], graph.shape[1]), graph[b[j : j + (1 << 14)]].ravel()
            other = (to >= 0) & (label[who] != label[to])
            code = np.unique(who[other] * n + to[other])
            who, to = code // n, code % n
            hit = np.concatenate([(x[who[k : k + 65536]] * x[to[k : k + 65536]]).sum(1) for k in range(0, len(who), 65536)] or [np.empty(0)]) >= cosine
            fresh.append(code[hit])
        code = np.unique(np.concatenate(fresh))
        a, b = code // n, code % n
        link = _labels(n, np.r_[a, np.arange(n)], np.r_[b, label])
        if (link == label).all():
            break
        label = link
    return label


def _centres(rows: DataFrame, total: int, k: int, overlap: int) -> tuple[np.ndarray | None, int]:
    """Centres of the first level, and how many of them a row goes to."""
    if k < 2:
        return None, 1
    pool = unit(sample(rows, SAMPLE, total, "clusters")[1])
    centres = kmeans(pool, min(k, CLUSTERS, len(pool)))
    return centres, min(overlap, len(centres))


_PLACED = "vec_id long, vec array<double>, copies long, home int"


def _nearest_homes(x: np.ndarray, centres: np.ndarray | None, over: int) -> np.ndarray:
    if centres is None or len(centres) == 1:
        return np.zeros((len(x), 1), np.int64)
    over = min(over, len(centres))
    return np.argpartition(-(x @ centres.T), over - 1, axis=1)[:, :over]


def _placed(ws: Workspace, rows: DataFrame, total: int, overlap: int) -> DataFrame:
    """``(shard string, vec_id, vec, copies)``: every row in each of its ``overlap`` nearest clusters; large ones are dealt in parts."""
    k = max(1, round(total / SHARD))
    centres, over = _centres(rows, total, k, overlap)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                homes = _nearest_homes(unit(matrix(b.column(1))), centres, over)
                at = pa.array(np.repeat(np.arange(b.num_rows), homes.shape[1]))
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns], pa.array(homes.ravel(), pa.int32())], names=["vec_id", "vec", "copies", "home"])

    placed = rows.select("vec_id", "vec", "copies").mapInArrow(assign, _PLACED)
    if k > CLUSTERS:
        # a second level: each cluster is cut by centres learned in one task from a bounded sample of its rows
        placed = ws.table(placed)
        sizes = placed.groupBy("home").agg(F.count(F.lit(1)).alias("n"))  # a row for each cluster, CLUSTERS at most
        draw = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit("fine")), 11) / float(1 << 53)
        some = placed.join(F.broadcast(sizes), "home").where(draw * F.col("n") < FINE_SAMPLE)

        def learn(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            pool = unit(matrix(group.column("vec").slice(0, 2 * FINE_SAMPLE)))
            fine = kmeans(pool, max(1, min(len(pool), round(group.column("n")[0].as_py() / SHARD), CLUSTERS)))
            return pa.table({"home": pa.array([key[0].as_py()], pa.int32()), "fine": pa.array([fine.ravel()], pa.list_(pa.float64()))})

        fine = ws.table(some.groupBy("home").applyInArrow(learn, "home int, fine array<double>"))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, home = unit(matrix(b.column(1))), b.column(3).to_numpy()
                shard = np.empty(len(x), object)
                for h in np.unique(home):
                    at = np.flatnonzero(home == h)
                    c = b.column(4)[int(at[0])].values.to_numpy().reshape(-1, x.shape[1])
                    shard[at] = [f"{h}.{f}" for f in _nearest_homes(x[at], c, 1)[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.string()), *b.columns[:3]], names=["shard", "vec_id", "vec", "copies"])

        dealt = placed.join(fine, "home").select("vec_id", "vec", "copies", "home", "fine").mapInArrow(split, "shard string, vec_id long, vec array<double>, copies long")
    else:
        dealt = placed.select(F.col("home").cast("string").alias("shard"), "vec_id", "vec", "copies")
    dealt = ws.table(dealt)
    large = dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (LARGEST * SHARD * over)).cast("int").alias("parts")).where("parts > 1")
    part = F.when(F.col("parts").isNotNull(), F.concat_ws("/", "shard", F.pmod(F.xxhash64("vec_id", "shard"), F.col("parts")).cast("string"))).otherwise(F.col("shard"))
    return ws.table(dealt.join(large, "shard", "left").select(part.alias("shard"), "vec_id", "vec", "copies"))


def _local(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A shard's ids, ascending, and unit vectors, in double precision."""
    group = group.take(pa.array(np.argsort(group.column("vec_id").to_numpy(), kind="stable")))
    return group.column("vec_id").to_numpy(), unit(matrix(group.column("vec")))


def flat_graph(ws: Workspace, placed: DataFrame, degree: int) -> DataFrame:
    """``(vec_id, near array<struct<to, sim>>)``: the pruned lists of all shards, united by row; ``degree`` for each shard a row is in at most."""
    near = pa.struct([("to", pa.int64()), ("sim", pa.float32())])

    def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ids, x = _local(group)
        graph, _ = build_graph(x.astype(np.float32), degree) if len(ids) > 1 else (np.full((len(ids), 1), -1), 0)
        a, i = np.nonzero(graph >= 0)
        b = graph[a, i]
        sim = np.concatenate([(x[a[j : j + 65536]] * x[b[j : j + 65536]]).sum(1) for j in range(0, len(a), 65536)] or [np.empty(0)])
        start = np.searchsorted(a, np.arange(len(ids) + 1)).astype(np.int32)
        ends = pa.StructArray.from_arrays([pa.array(ids[b], pa.int64()), pa.array(sim.astype(np.float32))], fields=list(near))
        return pa.table({"vec_id": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(start), ends)})

    lists = placed.groupBy("shard").applyInArrow(build, "vec_id long, near array<struct<to:long,sim:float>>")
    return ws.table(lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))


def _edges(ws: Workspace, rows: DataFrame, total: int, cosine: float, overlap: int, degree: int) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``, links that join the components of what searches over the flat graph find, and that graph."""
    placed = _placed(ws, rows, total, overlap)
    graph = flat_graph(ws, placed, degree)
    least = 2 * cosine * cosine - 1 if cosine > 0 else -1.0  # rows less alike than that have no row within range of both

    def seek(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group.column("vec_id").to_numpy(), kind="stable")))
        ids, x = group.column("vec_id").to_numpy(), unit(matrix(group.column("vec")))
        near = group.column("near").combine_chunks()
        count = np.where(near.is_valid().to_numpy(zero_copy_only=False), near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        flat = near.flatten()
        to, sim = flat.field("to").to_numpy(), flat.field("sim").to_numpy()
        owner = np.repeat(np.arange(len(ids)), count)
        at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        inside = ids[at] == to
        own, end = owner[inside], at[inside]
        nth = np.arange(len(own)) - np.searchsorted(own, own)
        lists = np.full((len(ids), max(1, int(nth.max()) + 1 if len(nth) else 1)), -1)
        lists[own, nth] = end
        label = range_search(x, lists, int((x @ x.mean(0)).argmax()), cosine)
        linked = np.bincount(label, minlength=len(ids))[label] > 1
        child = np.flatnonzero(label != np.arange(len(ids)))
        # edges within the range lead out of the shard, too; other edges out of linked rows are the frontier
        out = np.flatnonzero(~inside & (sim >= cosine - 1e-6))
        exits = np.flatnonzero(~inside & linked[owner] & (sim < cosine + 1e-6) & (sim >= least - 1e-6))
        a = np.r_[ids[child], ids[owner[out]], np.zeros(len(exits), np.int64)]
        b = np.r_[ids[label[child]], to[out], to[exits]]
        kind = np.r_[np.zeros(len(child), np.int32), np.full(len(out), 1, np.int32), np.full(len(exits), 2, np.int32)]
        member = ids[linked]
        a, b, kind = np.r_[a, ids[label[linked]]], np.r_[b, member], np.r_[kind, np.full(len(member), 3, np.int32)]
        return pa.table({"shard": pa.array([key[0].as_py()] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "kind": pa.array(kind, pa.int32())})

    sought = ws.table(placed.join(graph, "vec_id", "left").select("shard", "vec_id", "vec", "near").groupBy("shard").applyInArrow(seek, "shard string, a long, b long, kind int"))
    # the rows at the frontier, and those they are met with, of each shard
    front = sought.where("kind >= 2").select("shard", F.col("b").alias("vec_id"), F.when(F.col("kind") == 3, F.col("a")).alias("root")).distinct()

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        comes = ~group.column("root").is_valid().to_numpy()
        ids, x, root = group.column("vec_id").to_numpy(), unit(matrix(group.column("vec"))), group.column("root").fill_null(0).to_numpy()
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(0, int(comes.sum()), 512):
            p, q = np.nonzero(x[comes][i : i + 512] @ x[~comes].T >= cosine)
            pair = np.unique(np.stack([ids[comes][i + p], root[~comes][q]], 1), axis=0)  # one link to each component in range
            a.append(pair[:, 0])
            b.append(pair[:, 1])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    met = front.join(rows.select("vec_id", "vec"), "vec_id").groupBy("shard").applyInArrow(meet, "a long, b long")
    # lists hold similarities in single precision: edges out of the shard are verified in double
    near = sought.where("kind = 1").select("a", "b").distinct()
    checked = near.join(rows.select(F.col("vec_id").alias("a"), F.col("vec").alias("va")), "a").join(rows.select(F.col("vec_id").alias("b"), F.col("vec").alias("vb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                good = (unit(matrix(b.column(2))) * unit(matrix(b.column(3)))).sum(1) >= cosine
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good))

    checked = checked.select("a", "b", "va", "vb").mapInArrow(verify, "a long, b long")
    return ws.table(sought.where("kind = 0").select("a", "b").union(met).union(checked).distinct()), graph


def _forest(found: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (a, b) that span the components of a group's links, each to its smallest row."""
    a: list[int] = []
    b: list[int] = []
    left = np.ones(len(ids), bool)
    for root in np.argsort(ids, kind="stable").tolist():
        if not left[root]:
            continue
        left[root] = False
        front = found[root] & left
        while front.any():
            left &= ~front
            at = np.flatnonzero(front)
            a += ids[at].tolist()
            b += [int(ids[root])] * len(at)
            front = found[at].any(0) & left
    return a, b


def _paired(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with own of their ``pieces`` and every pair (i, j) of pieces that own is in: any two rows of a key meet in one pair."""
    own = F.pmod(F.xxhash64("vec_id", F.lit("piece")), F.col("pieces")).cast("int")
    pair = lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j"))
    met = rows.withColumn("own", own).withColumn("met", F.explode(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), pair)))
    return met.select(key, "met.i", "met.j", "own", "vec_id", "vec", "copies")


def _all_edges(ws: Workspace, classes: DataFrame, total: int, cosine: float) -> DataFrame:
    """``(a, b)``: links that span the components of all links there are, from every two blocks of rows of one length."""
    rows = classes.select(F.size("vec").alias("all"), "vec_id", "vec", "copies", F.lit(-(-total // BLOCK)).alias("pieces"))
    met = _paired(rows, "all")

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group.column("vec_id").to_numpy(), kind="stable")))
        ids = group.column("vec_id").to_numpy()
        x = unit(matrix(group.column("vec")))
        found = np.zeros((len(x), len(x)), bool)
        for p in range(0, len(x), 512):
            found[p : p + 512] = x[p : p + 512] @ x.T >= cosine
        np.fill_diagonal(found, False)
        found |= found.T
        a, b = _forest(found, ids)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return ws.table(met.groupBy("all", "i", "j").applyInArrow(compare, "a long, b long"))


def _counts(ws: Workspace, classes: DataFrame, comps: DataFrame, cosine: float) -> DataFrame:
    """``(vec_id, n)``: every class's links within its component, copies included, whichever shards its members were in.

    Members within half the range's angle of the component's first are its core, all linked
    with each other. The others meet every piece of the component.
    """
    first = classes.select(F.col("vec_id").alias("component"), F.col("vec").alias("first"))
    told = classes.join(comps.select(F.col("node").alias("vec_id"), "component"), "vec_id").join(first, "component").select("component", "vec_id", "vec", "copies", "first")
    half = np.cos(np.arccos(np.clip(cosine, -1, 1)) / 2 - 1e-7) if cosine > 0 else 2.0

    def core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros(0, bool)
            if b.num_rows:
                size = b.column(2).value_lengths().to_numpy()
                x = np.zeros(b.num_rows, bool)
                for d in np.unique(size):
                    at = pa.array(np.flatnonzero(size == d))
                    x[size == d] = (unit(matrix(b.column(2).take(at))) * unit(matrix(b.column(4).take(at)))).sum(1) >= half
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(x)], names=["component", "vec_id", "vec", "copies", "core"])

    rows = ws.table(told.mapInArrow(core, "component long, vec_id long, vec array<double>, copies long, core boolean"))
    sizes = ws.table(rows.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"), F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("inner"), F.min("core").alias("whole")))
    sure = rows.where("core").join(sizes, "component").select("vec_id", (F.col("inner") - F.col("copies")).alias("n"))
    rest = rows.join(sizes.where("not whole").select("component", "pieces"), "component")
    own = rest.select("component", F.pmod(F.xxhash64("vec_id", F.lit("piece")), F.col("pieces")).cast("int").alias("piece"), F.lit(False).alias("asks"), "vec_id", "vec", "copies", "core")
    asks = rest.where("not core").select("component", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(True).alias("asks"), "vec_id", "vec", "copies", "core")

    def count(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        asks, ids, copies, inner = (group.column(c).to_numpy() for c in ("asks", "vec_id", "copies", "core"))
        x, n = unit(matrix(group.column("vec"))), np.zeros(len(ids), np.int64)
        one, two = np.flatnonzero(asks), np.flatnonzero(~asks)
        for p in range(0, len(one), 512):
            at = one[p : p + 512]
            link = (x[at] @ x[two].T >= cosine) & (ids[at, None] != ids[two])
            n[at] += link @ copies[two]
            n[two] += np.where(inner[two], copies[at] @ link, 0)  # an asker is counted where its own piece is met
        return pa.table({"vec_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64())})

    met = own.union(asks).groupBy("component", "piece").applyInArrow(count, "vec_id long, n long")
    return ws.table(sure.union(met).groupBy("vec_id").agg(F.sum("n").alias("n")))


def _audit(classes: DataFrame, ids: np.ndarray, queries: np.ndarray, cosine: float) -> dict[int, int]:
    """The true number of links of a bounded set of classes, copies included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = unit(queries)
        total = np.zeros(len(q), np.int64)
        for b in batches:
            if b.num_rows:
                x, own, copies = unit(matrix(b.column(1))), b.column(0).to_numpy(), b.column(2).to_numpy()
                for p in range(0, len(x), 512):
                    link = (x[p : p + 512] @ q.T >= cosine) & (own[p : p + 512, None] != ids)
                    total += copies[p : p + 512] @ link
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["vec_id", "n"])

    counts = classes.select("vec_id", "vec", "copies").mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    return {r.vec_id: r.n for r in counts.collect()}


def _audited(rows: DataFrame, graph: DataFrame, counts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of an audit, ids ascending, and their vectors: as many of each kind as AUDITS says, so that the driver may hold them."""
    chance, linked, near = AUDITS
    best = F.array_max(F.transform("near", lambda x: x["sim"]))
    told = counts.where("n > 0").select("vec_id")
    ids = [sample(rows, chance, total, "audit")[0]]
    ids.append(told.orderBy(F.xxhash64("vec_id", F.lit("audit")), "vec_id").limit(linked).toArrow().column(0).to_numpy())
    ids.append(graph.select("vec_id", best.alias("best")).where("best is not null").join(told, "vec_id", "anti").orderBy(F.desc("best"), "vec_id").limit(near).select("vec_id").toArrow().column(0).to_numpy())
    some = np.unique(np.concatenate(ids))
    got = rows.where(F.col("vec_id").isin(some.tolist())).select("vec_id", "vec").toArrow()
    order = np.argsort(got.column("vec_id").to_numpy())
    return got.column("vec_id").to_numpy()[order], matrix(got.column("vec"))[order] if len(some) else np.zeros((0, 0))


def mean_recall(got: dict[int, int], truth: dict[int, int]) -> float:
    """The mean share of a row's links that was found, over rows with few links or over those with many: the lesser."""
    parts = [[min(got.get(i, 0), n) / n for i, n in truth.items() if (n <= FEW) == few] for few in (True, False)]
    return min((sum(p) / len(p) for p in parts if p), default=1.0)


def _linked(ws: Workspace, rows: DataFrame, total: int, cosine: float, whole: bool) -> tuple[DataFrame, DataFrame, float | None]:
    """Components (node, component), counts (vec_id, n) and the recall of classes of one length; ``whole``: of all, by blocks."""
    truth: dict[int, int] = {}
    recall = None
    edges = rows.sparkSession.createDataFrame([], "a long, b long")
    for overlap, degree in [(None, None)] if whole else [*zip(OVERLAPS, DEGREES), (None, None)]:
        if overlap is None:
            edges = _all_edges(ws, rows, total, cosine)
        else:
            found, graph = _edges(ws, rows, total, cosine, overlap, degree)
            edges = edges.union(found)  # a later level adds to what is found
        comps = ws.table(connected_components(ws, edges))
        counts = _counts(ws, rows, comps, cosine)
        if overlap is not None:
            ids, q = _audited(rows, graph, counts, total)
            truth |= {i: n for i, n in _audit(rows, ids, q, cosine).items() if n} if len(ids) else {}
        got = {r.vec_id: r.n for r in counts.where(F.col("vec_id").isin(list(truth))).collect()} if truth else {}
        recall = mean_recall(got, truth) if truth else None
        if recall is None or recall >= RECALL:
            break
    return comps, counts, recall


def near_duplicates(table: DataFrame, column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept, recall)`` for each row of ``table``.

    n_links counts the other vectors of the same length whose cosine is ``cosine`` or
    more, as far as found; recall says what share of an audited row's true links that was on
    average, null where no audited row has any. Vectors that can't be compared link with
    nothing and are kept. Rows that repeat an id are one vector, each answered alike; a row
    without an id has no component. Extra columns are ignored; an empty table gives no rows.
    """
    ws = Workspace(table.sparkSession, "vecdedup")
    rows = ws.table(valid_vectors(table, column))
    classes = ws.table(rows.groupBy("vec").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")))
    sizes = lengths(classes)
    none = table.sparkSession.createDataFrame([], "a long, b long")
    comps, counts, recalls = none.selectExpr("a as node", "b as component"), none.selectExpr("a as vec_id", "b as n"), []
    for d in [*list(sizes)[:INDEXED], None]:
        own = classes.where(F.size("vec") == d) if d else classes.where(~F.size("vec").isin(list(sizes)[:INDEXED]))
        if d is None and len(sizes) <= INDEXED:
            continue
        c, n, r = _linked(ws, own, sizes[d] if d else sum(list(sizes.values())[INDEXED:]), cosine, d is None)
        comps, counts, recalls = comps.union(c), counts.union(n), recalls + [r] * (r is not None)
    done = classes.join(counts, "vec_id", "left").join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    done = done.select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    each = rows.join(done, "vec").select("vec_id", "n_links", "component_id")
    all_rows = table.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = all_rows.join(each, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    recall = F.lit(min(recalls) if recalls else None).cast("double")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("recall", recall)


def op10_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
