"""Hard negatives by distributed radix selection.

Scores are integers, so the k best rows of a window (an anchor with a range of scores) are
found without sorting any: blocks of rows count scores by bucket, the sums of these
counts tell the bucket that holds the kth row, and the next pass counts only inside it, at a
finer width. Rows of one score are told apart by further digits, those of their ids. A
window is settled once its bucket is small or holds one score and one id; a last pass
then gathers the rows down to there, ``k`` and a few at most.

A block never counts below the bucket in which it has k rows of its own: the kth of all
rows can't be lower. Rows meet anchors in blocks of a grid, each a task's group of bounded
size, whatever labels, copies or ties there are. State and counts are written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import Workspace

#: Rows and windows that meet in one group of the grid at most; smaller tables are cut in about 64 blocks of 1,024 rows or more.
ROWS, WINDOWS = 16384, 8192
#: Buckets of a digit, and rows more than wanted with which a window counts as settled.
BUCKETS, SLACK = 1024, 16
#: Components of a magnitude whose products over a row fit a long.
FIT = float(1 << 62)

#: A window: an anchor's vector and label, whether it takes rows of its label, scores from low to high, and the search's state.
#: Left to find are ``need`` rows among scores ``lo`` to ``hi``; if these are one score, among ids ``id_lo`` to ``id_hi``.
WINDOW = "anchor_id long, key long, same boolean, label int, vec array<long>, low long, high long, lo long, hi long, id_lo long, id_hi long, need long, done boolean"
STATE = ["lo", "hi", "id_lo", "id_hi", "need", "done"]


def quantised(table: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, label, vec array<long>)``: components x as floor(scale * x), one row for each id.

    Left out are null ids, labels and vectors, empty vectors, those with a null or
    non-finite component, and those so long that scores need not fit a long. Of rows
    sharing an id the one with the least vector, then label, counts.
    """
    x = table.where("vec_id is not null and label is not null and embedding is not null")
    x = x.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    x = x.where((F.size("x") > 0) & F.coalesce(fine, F.lit(False))).where((norm + F.size("x")) * float(scale * scale * 2) < FIT)
    whole = x.select("vec_id", F.struct(F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("vec"), "label").alias("r"))
    return whole.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.vec")


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every sum stays below 2^53, in longs beyond."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < float(1 << 53):
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _meet(rows: pa.Table, windows: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of one length, and for all their qualifying rows: the window's place, score and id."""
    dims_r, dims_w = (np.asarray(pc.list_value_length(t.column("vec"))) for t in (rows, windows))
    for d in np.intersect1d(dims_r, dims_w):
        r, w = rows.filter(pa.array(dims_r == d)), windows.filter(pa.array(dims_w == d))
        ids, labels, vecs = r.column("vec_id").to_numpy(), r.column("label").to_numpy(), _longs(r)
        for i in range(0, w.num_rows, 256):
            part = w.slice(i, 256)
            anchor, at, back = np.unique(part.column("anchor_id").to_numpy(), return_index=True, return_inverse=True)
            s = _scores(_longs(part)[at], vecs)[back]
            low, high = (part.column(c).to_numpy()[:, None] for c in ("low", "high"))
            alike = labels[None, :] == part.column("label").to_numpy()[:, None]
            same = np.asarray(part.column("same").to_pylist(), bool)[:, None]
            k, j = np.nonzero((s >= low) & (s <= high) & (alike == same) & (ids[None, :] != anchor[back][:, None]))
            yield part, k, s[k, j], ids[j]


def _longs(table: pa.Table) -> np.ndarray:
    flat = table.column("vec").combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _bucket(lo: np.ndarray, hi: np.ndarray, id_lo: np.ndarray, id_hi: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are inside the search's interval, and their bucket: highest scores first, in one score the least ids first."""
    one = lo == hi
    inside = (score >= lo) & (score <= hi) & (~one | ((ids >= id_lo) & (ids <= id_hi)))
    span = np.where(one, id_hi.view(np.uint64) - id_lo.view(np.uint64), (hi - lo).view(np.uint64))
    far = np.where(one, ids.view(np.uint64) - id_lo.view(np.uint64), (hi - score).view(np.uint64))
    return inside, (far // (span // np.uint64(BUCKETS) + np.uint64(1))).astype(np.int64)


def _count(key: tuple, rows: pa.Table, windows: pa.Table) -> pa.Table:
    """(anchor_id, key, bucket, c) of one group of the grid, down to the bucket with which each window has ``need`` rows here."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for part, k, score, ids in _meet(rows, windows) if rows.num_rows and windows.num_rows else ():
        state = [np.ascontiguousarray(part.column(c).to_numpy()) for c in STATE[:4]]
        inside, bucket = _bucket(*[x[k] for x in state], score, ids)
        flat, c = np.unique(k[inside] * BUCKETS + bucket[inside], return_counts=True)
        w = flat // BUCKETS
        total = np.cumsum(c)
        first = np.searchsorted(w, w)
        before = total - c - (total[first] - c[first])
        keep = before < part.column("need").to_numpy()[w]
        for o, x in zip(out, (part.column("anchor_id").to_numpy()[w], part.column("key").to_numpy()[w], flat % BUCKETS, c)):
            o.append(x[keep])
    return pa.table({n: pa.array(np.concatenate(o) if o else [], pa.int64()) for n, o in zip(("anchor_id", "key", "bucket", "c"), out)})


def _gather(key: tuple, rows: pa.Table, windows: pa.Table) -> pa.Table:
    """(anchor_id, key, vec_id, score) of the rows above a settled window's interval, or in it."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for part, k, score, ids in _meet(rows, windows) if rows.num_rows and windows.num_rows else ():
        lo, hi, id_hi = (part.column(c).to_numpy()[k] for c in ("lo", "hi", "id_hi"))
        keep = (score > lo) | ((score == lo) & ((lo < hi) | (ids <= id_hi)))
        for o, x in zip(out, (part.column("anchor_id").to_numpy()[k], part.column("key").to_numpy()[k], ids, score)):
            o.append(x[keep])
    return pa.table({n: pa.array(np.concatenate(o) if o else [], pa.int64()) for n, o in zip(("anchor_id", "key", "vec_id", "score"), out)})


def _on_grid(rows: DataFrame, windows: DataFrame, n_rows: int, n_windows: int, run, schema: str) -> DataFrame:
    """``run`` over every block of rows beside every block of windows."""
    down, across = -(-n_rows // min(ROWS, max(1024, n_rows // 64))), -(-n_windows // WINDOWS)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    r = rows.withColumn("_r", F.pmod(F.xxhash64("vec_id"), F.lit(down))).withColumn("_w", every(across))
    # windows of one anchor stay together, so that its products are taken once
    w = windows.withColumn("_w", F.pmod(F.xxhash64("anchor_id"), F.lit(across))).withColumn("_r", every(down))
    return r.groupBy("_r", "_w").cogroup(w.groupBy("_r", "_w")).applyInArrow(run, schema)


def select(ws: Workspace, rows: DataFrame, windows: DataFrame) -> DataFrame:
    """``(anchor_id, key, vec_id, score)`` of the ``need`` best rows (all, if fewer) of each of ``windows``, and few others.

    Best are high scores, then small ids. ``rows(vec_id, label, vec)`` and ``windows`` are written tables;
    the driver holds a count of windows for each pass. A window whose low exceeds its high gets nothing.
    """
    n_rows = rows.count()
    ids = rows.agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("b")).first()
    states, open_ = [], ws.table(windows.where("low <= high"))
    written = [open_]
    names = [c.split()[0] for c in WINDOW.split(", ")]
    while n_rows and (left := open_.count()):
        counts = _on_grid(rows, open_, n_rows, left, _count, "anchor_id long, key long, bucket long, c long")
        each = counts.groupBy("anchor_id", "key", "bucket").agg(F.sum("c").alias("c"))
        summed = each.withColumn("_to", F.sum("c").over(Window.partitionBy("anchor_id", "key").orderBy("bucket")))
        kth = summed.join(open_.select("anchor_id", "key", "need"), ["anchor_id", "key"]).where((F.col("_to") >= F.col("need")) & (F.col("_to") - F.col("c") < F.col("need")))
        found = open_.join(kth.select("anchor_id", "key", "bucket", "c", "_to"), ["anchor_id", "key"], "left")
        one, b = F.col("lo") == F.col("hi"), F.col("bucket")
        wide = F.expr(f"(hi - lo) div {BUCKETS} + 1")
        hi = F.col("hi") - b * wide
        # ids may span more than a long holds
        id_lo, step = F.col("id_lo").cast("decimal(38,0)"), F.expr(f"(cast(id_hi as decimal(20,0)) - id_lo) div {BUCKETS} + 1").cast("decimal(20,0)")
        need = F.col("need") - F.col("_to") + F.col("c")
        new = {
            "lo": F.when(one, F.col("lo")).otherwise(F.greatest(F.col("lo"), hi - wide + 1)),
            "hi": F.when(one, F.col("hi")).otherwise(hi),
            "id_lo": F.when(one, (id_lo + b.cast("decimal(10,0)") * step).cast("long")).otherwise(F.col("id_lo")),
            "id_hi": F.when(one, F.least(F.col("id_hi"), (id_lo + (b + 1).cast("decimal(10,0)") * step - 1).cast("long"))).otherwise(F.col("id_hi")),
            "need": need,
        }
        # a window without a kth row takes all it has
        told = {c: F.when(b.isNull(), F.col(c)).otherwise(x) for c, x in new.items()} | {"done": b.isNull() | (F.col("c") <= need + SLACK)}
        states.append(ws.table(found.select(*[told[c].alias(c) if c in told else F.col(c) for c in names])))
        open_ = states[-1].where("not done")
    done = written[0].limit(0)
    for s in states:
        done = done.union(s.where("done"))
    done = ws.table(done)
    got = ws.table(_on_grid(rows, done, max(1, n_rows), max(1, done.count()), _gather, "anchor_id long, key long, vec_id long, score long"))
    ws.drop(done, *written, *states, sweep=False)
    return got


def _windows(df: DataFrame, key, same: bool, low, high, ids, need: int) -> DataFrame:
    """Rows of (anchor_id, label, vec) as windows."""
    told = {"key": key, "same": F.lit(same), "low": low, "high": high, "lo": low, "hi": high, "id_lo": F.lit(ids.a), "id_hi": F.lit(ids.b), "need": F.lit(need), "done": F.lit(False)}
    kinds = [c.split() for c in WINDOW.split(", ")]
    return df.select(*[(told[n] if n in told else F.col(n)).cast(t).alias(n) for n, t in kinds])


def mine(table: DataFrame, anchors, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` over ``table(vec_id, label, embedding)``.

    ``anchors`` is a condition on vec_id. A score is the integer inner product of quantised
    vectors; rows of another length than the anchor's are not compared. Positives are an
    anchor's ``positives`` best other rows of its label (all, if fewer), negatives of a
    positive the ``negatives`` best rows of other labels with a score from ``least`` to
    ``most`` hundredths of the positive's (all, if fewer). Ties go to smaller ids. Rows without
    an id, a label or a finite vector take no part (see :func:`quantised`); rows
    under one id count once; other columns are ignored. No rows, anchors or positives give no rows.
    """
    spark = table.sparkSession
    ws = Workspace(spark, "negatives")
    rows = ws.table(quantised(table, scale))
    ids = rows.agg(F.coalesce(F.min("vec_id"), F.lit(0)).alias("a"), F.coalesce(F.max("vec_id"), F.lit(0)).alias("b"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v)).alias("n")).first()
    chosen = rows.where(anchors).select(F.col("vec_id").alias("anchor_id"), "label", "vec")
    # no score exceeds the product of the two lengths; doubled rounding is allowed for
    reach = F.ceil(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v)) * float(ids.n or 0.0) ** 0.5 * 1.000001 + 1).cast("long")
    first = _windows(chosen, F.lit(0), True, -reach, reach, ids, positives)
    found = select(ws, rows, ws.table(first))
    by = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = ws.table(found.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # of 100 q + r hundredths each; products stay within a long
    q, r = F.expr("(key - pmod(key, 100)) div 100"), F.expr("pmod(key, 100)")
    low, high = q * least + F.ceil(r * least / 100), q * most + F.floor(r * most / 100)
    asked = chosen.join(near.select("anchor_id", F.col("positive_score").alias("key")).distinct(), "anchor_id")
    second = _windows(asked, F.col("key"), False, low, high, ids, negatives)
    got = select(ws, rows, ws.table(second))
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    best = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    told = near.join(best, (near.positive_score == best.key) & (near.anchor_id == best.anchor_id))
    return told.select(near.anchor_id, "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Every 50th id as anchor over all embeddings; each 7th id's label is first moved on by one, of ten."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH rows_ AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM rows_ a JOIN rows_ b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank, n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positive p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 3
"""
