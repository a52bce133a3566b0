"""Discrimination between classes by group: stratified folds of whole groups, logistic regression by sums over rows, scores with group intervals.

Training takes no row anywhere: each Newton step is one aggregate that gives, for every model at
once, the loss, its gradient and its curvature, and what is collected is one short row for each
model. Models are a feature set and the fold they leave out; all of them share a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import resampling
from .staging import Staging

#: Groups of a class that are dealt in one window.
DEALT = 1 << 16


def group_folds(df: DataFrame, group: str, label: str, folds: int = 5) -> DataFrame:
    """``(group, fold)``: whole groups dealt to folds so that rows and classes come out even.

    Groups of one leading class (the most frequent, ties to the lesser name) are ordered by size and dealt
    back and forth, each class beginning at the next fold. Beyond 65,536 groups of a class
    they are dealt in parts by digest. Rows without a group or a class are left out.
    """
    counts = df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("_c"))
    lead = counts.groupBy(group).agg(F.sum("_c").alias("_n"), F.min(F.struct((-F.col("_c")).alias("c"), F.col(label).alias("l"))).alias("_x"))
    led = lead.select(group, "_n", F.col("_x.l").alias("_lead"))
    most = led.groupBy("_lead").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 0
    part = F.pmod(F.xxhash64(group), F.lit(max(1, -(-most // DEALT))))
    nth = F.row_number().over(Window.partitionBy("_lead", part).orderBy(F.desc("_n"), group)) - 1
    kinds = sorted(r._lead for r in led.select("_lead").distinct().collect())  # classes are few
    first = F.coalesce(*[F.when(F.col("_lead") == k, F.lit(i)) for i, k in enumerate(kinds)], F.lit(0))
    there, back = nth % folds, folds - 1 - nth % folds
    return led.select(group, F.pmod(F.when(F.floor(nth / folds) % 2 == 0, there).otherwise(back) + first, F.lit(folds)).cast("int").alias("fold"))


def _prepared(df: DataFrame, folded: DataFrame, group: str, label: str, features: list[str], kinds: list) -> DataFrame:
    x = [F.col(c).cast("double") for c in features]
    fine = F.col(label).isNotNull()
    for c in x:
        fine = fine & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    at = F.coalesce(*[F.when(F.col(label) == k, F.lit(i)) for i, k in enumerate(kinds)]).cast("int")
    return df.where(fine).join(folded, group).select(group, "fold", at.alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)])


def softmax_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient (classes, inputs) and curvature of a weighted multinomial logistic model over some rows.

    Inputs and classes are few and rows are many, so that everything is worked out along the rows: a row of ``x.T`` for each input.
    """
    t = np.ascontiguousarray(x.T)
    k, d = theta.shape
    z = theta @ t
    z -= z.max(0)
    p = np.exp(z, out=z)
    p /= p.sum(0)
    true = np.arange(k)[:, None] == y
    loss = -float(w @ np.log(np.maximum(p.sum(0, where=true), 1e-300)))
    wp = p * w
    g = (wp - np.where(true, w, 0.0)) @ t.T
    h = np.empty((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            h[a, :, b] = (t * (wp[a] * (1 - p[a]) if a == b else -wp[a] * p[b])) @ t.T
            h[b, :, a] = h[a, :, b].T
    return loss, g, h.reshape(k * d, k * d)


def _inputs(x: np.ndarray, columns: list[int], center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[:, columns] - center[columns]) / scale[columns], np.ones((len(x), 1))], 1)


class _Model:
    """One feature set with one fold left out (None: none), and where its search stands."""

    def __init__(self, columns: list[int], out: int | None, k: int):
        self.columns, self.out = columns, out
        self.theta = np.zeros((k, len(columns) + 1))
        self.step, self.loss, self.done = None, np.inf, False

    def move(self, loss: float, g: np.ndarray, h: np.ndarray, penalty: float, tol: float) -> None:
        """The next point: a Newton step of loss + penalty / 2 * squares (without intercepts), halved while the last one went up."""
        loss += 0.5 * penalty * float((self.theta[:, :-1] ** 2).sum())
        if loss > self.loss + 1e-9 * abs(self.loss):
            self.step = self.step / 2
            self.theta = self.theta - self.step
            return
        self.loss = loss
        ridge = np.full(self.theta.shape, penalty)
        ridge[:, -1] = 0
        g = g + ridge * self.theta
        # a constant added to all intercepts changes nothing: the least step of those that solve
        self.step = np.linalg.lstsq(h + np.diag(ridge.reshape(-1)), -g.reshape(-1), rcond=1e-12)[0].reshape(self.theta.shape)
        self.theta = self.theta + self.step
        self.done = float(np.abs(self.step).max()) < tol


def train(rows: DataFrame, sets: list[list[int]], outs: list[int | None], k: int, n_features: int, penalty: float = 1.0, rounds: int = 40, tol: float = 1e-9) -> tuple[list[_Model], np.ndarray, np.ndarray]:
    """Models of ``rows(fold, y, x0..)`` for each feature set and fold left out; with them the centres and scales (folds left out, features).

    Features are taken off their median and divided by their interquartile range over the rows that a model learns from (approximate percentiles, off by a
    ten-thousandth of the ranks at most), classes weigh alike, and the penalty is that of one unit of loss.
    """
    learns = lambda out: F.lit(True) if out is None else F.col("fold") != out
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    got = rows.agg(*[F.percentile_approx(F.when(learns(o), F.col(f"x{i}")), at, F.lit(10_000)).alias(f"q{m}_{i}") for m, o in enumerate(outs) for i in range(n_features)]).first()
    quartiles = np.array([[got[f"q{m}_{i}"] or [0.0, 0.0, 0.0] for i in range(n_features)] for m in range(len(outs))], float)
    center, scale = quartiles[:, :, 1], quartiles[:, :, 2] - quartiles[:, :, 0]
    scale = np.where(scale > 0, scale, 1.0)
    seen = {(r.fold, r.y): r.c for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("c")).collect()}
    of_class = np.array([[sum(c for (f, y), c in seen.items() if y == j and f != o) for j in range(k)] for o in outs], float)
    per_class = np.where(of_class > 0, of_class.sum(1, keepdims=True) / np.maximum((of_class > 0).sum(1, keepdims=True), 1) / np.maximum(of_class, 1), 0.0)
    models = [_Model(s, o, k) for s in sets for o in outs]
    place = {o: m for m, o in enumerate(outs)}
    every = list(range(n_features))
    for _ in range(rounds):
        open_ = [(i, m.columns, m.out, m.theta) for i, m in enumerate(models) if not m.done]
        if not open_ or not seen:
            break

        def sums(batches: Iterator[pa.RecordBatch], open_=open_) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                fold, y = b.column(0).to_numpy(), b.column(1).to_numpy()
                x = np.stack([b.column(2 + i).to_numpy() for i in range(n_features)], 1)
                told_apart: dict = {}  # rows that a model learns from, by the fold left out: as inputs, classes and weights
                for i, columns, out, theta in open_:
                    m = place[out]
                    if m not in told_apart:
                        keep = np.flatnonzero(fold != out) if out is not None else np.arange(len(y))
                        told_apart[m] = np.ascontiguousarray(_inputs(x[keep], every, center[m], scale[m]).T), y[keep], per_class[m][y[keep]]
                    given, truth, weight = told_apart[m]
                    loss, g, h = softmax_sums(given[[*columns, -1]].T, truth, weight, theta)
                    told = np.concatenate([[loss], g.reshape(-1), h.reshape(-1)])
                    total[i] = total[i] + told if i in total else told
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))], names=["model", "s"])

        parts = rows.select("fold", "y", *[f"x{i}" for i in range(n_features)]).mapInArrow(sums, "model int, s array<double>")
        summed = parts.select("model", F.posexplode("s").alias("at", "v")).groupBy("model", "at").agg(F.sum("v").alias("v"))
        told: dict[int, dict[int, float]] = {}
        for r in summed.collect():  # one short list for each model
            told.setdefault(r.model, {})[r.at] = r.v
        for i, got in told.items():
            flat = np.array([got[j] for j in range(len(got))])
            shape = models[i].theta.shape
            n = shape[0] * shape[1]
            models[i].move(flat[0], flat[1 : n + 1].reshape(shape), flat[n + 1 :].reshape(n, n), penalty, tol)
    return models, center, scale


def held_out_predictions(df: DataFrame, group: str, label: str, features: list[str], sets: dict[str, list[str]], folds: int = 5, penalty: float = 1.0) -> DataFrame:
    """``(group, fold, contract, truth, predicted)``: each row by the models that learned without its group, for each named feature set.

    Rows without a group, a class or with a feature that is null or not finite are left out; with fewer classes than
    two, or no rows, there is no prediction. Classes are few: their names and their counts by fold go to the driver.
    """
    kinds = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    kind = dict(df.dtypes)
    schema = f"`{group}` {kind[group]}, fold int, contract string, truth {kind[label]}, predicted {kind[label]}"
    if len(kinds) < 2:
        return df.sparkSession.createDataFrame([], schema)
    told = [[features.index(c) for c in s] for s in sets.values()]
    with Staging(df.sparkSession, "folds") as st:
        folded = st.keep(group_folds(df, group, label, folds))  # a row for each group: not worked out anew in each step
    rows = _prepared(df, folded, group, label, features, kinds)
    models, center, scale = train(rows, told, list(range(folds)), len(kinds), len(features), penalty)
    names, n_features = list(sets), len(features)
    known = [(names[i // folds], m.columns, m.out, m.theta) for i, m in enumerate(models)]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(kinds)
        for b in batches:
            fold = b.column(1).to_numpy()
            x = np.stack([b.column(3 + i).to_numpy() for i in range(n_features)], 1)
            for name in names:
                got = np.zeros(b.num_rows, np.int64)
                for contract, columns, out, theta in known:
                    mine = fold == out
                    if contract == name and mine.any():
                        got[mine] = (_inputs(x[mine], columns, center[out], scale[out]) @ theta.T).argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([name] * b.num_rows), labels.take(b.column(2)), labels.take(pa.array(got))], names=[group, "fold", "contract", "truth", "predicted"])

    return rows.mapInArrow(predict, schema)


def contract_scores(predictions: DataFrame, group: str, replicates: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """``(contract, score, estimate, low, high, replicates)`` of ``macro_f1`` and ``balanced_accuracy``, whole groups drawn with replacement.

    Counts by group, class and prediction are weighted for all replicates at once. Macro F1 is over all
    classes that occur; balanced accuracy is the mean recall of classes that a replicate holds.
    """
    cells = predictions.groupBy(group, "contract", "truth", "predicted").agg(F.count(F.lit(1)).alias("c"))
    sums = resampling.replicate_sums(cells, ["contract", "truth", "predicted"], [[group]], {"hits": F.col("c")}, replicates, seed)
    side = lambda c: sums.groupBy("contract", "replicate", F.col(c).alias("label")).agg(F.sum("hits").alias(c[0]))
    both = side("truth").join(side("predicted"), ["contract", "replicate", "label"], "full").na.fill(0.0, ["t", "p"])
    hit = sums.where("truth = predicted").select("contract", "replicate", F.col("truth").alias("label"), "hits")
    each = both.join(hit, ["contract", "replicate", "label"], "left").na.fill(0.0, ["hits"])
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("t") + F.col("p")), F.lit(0.0))
    by = each.groupBy("contract", "replicate").agg(F.avg(f1).alias("macro_f1"), F.avg(F.try_divide("hits", "t")).alias("balanced_accuracy"))
    long = by.select("contract", "replicate", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("v")) for s in ("macro_f1", "balanced_accuracy")])).alias("x")).select("contract", "replicate", "x.score", "x.v")
    return resampling.intervals(long, ["contract", "score"], "v", level)
