"""What the vector operators share: valid vectors, exact top lists, and cosine in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(table: DataFrame, column: str = "embedding") -> DataFrame:
    """``(vec_id, vec array<double>)`` of the vectors that can be compared, one row for each id.

    Left out are null ids, and vectors that are null, empty, zero, or hold null or
    non-finite components. Of different vectors under one id the least is taken.
    """
    vec = F.col(column).cast("array<double>")
    rows = table.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def lengths(vectors: DataFrame) -> dict[int, int]:
    """How many vectors there are of each length, the most frequent first; only vectors of one length are compared."""
    got = vectors.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.d: r.n for r in sorted(got, key=lambda r: (-r.n, -r.d))}


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column -> (rows, dimensions) in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], flat.type)
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever their magnitude."""
    if not m.size:
        return m
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k best rows other than itself; ties to the smaller id.

    With ``kinds`` of rows, a query meets those that its row of ``allowed`` has. Block
    products choose rows within a hair of the k-th; these are scored anew, each
    in the same order of additions wherever it stands, so that equal vectors tie.
    """
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    kinds = kinds[order] if kinds is not None else None
    out: list[list] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
    if not len(rows):
        return tuple(o[0] for o in out)  # type: ignore[return-value]
    for i in range(0, len(queries), 256):
        s = queries[i : i + 256] @ rows.T
        s[query_ids[i : i + 256, None] == ids[None, :]] = -np.inf
        if allowed is not None:
            s[~allowed[i : i + 256][:, kinds]] = -np.inf
        at = max(0, s.shape[1] - k)
        kth = np.partition(s, at, axis=1)[:, at] - 1e-9
        a, b = np.nonzero((s >= kth[:, None]) & (s > -np.inf))
        score = np.concatenate([(queries[i + a[j : j + 65536]] * rows[b[j : j + 65536]]).sum(1) for j in range(0, len(a), 65536)] or [np.empty(0)])
        best = np.lexsort((b, -score, a))
        a, b, score = a[best], b[best], score[best]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        keep = nth < k
        out[0].append(query_ids[i + a[keep]])
        out[1].append(ids[b[keep]])
        out[2].append(score[keep])
    return tuple(np.concatenate(o) for o in out)  # type: ignore[return-value]


def sample(vectors: DataFrame, most: int, total: int, salt: str) -> tuple[np.ndarray, np.ndarray]:
    """About ``most`` vectors at most, by a hash of the id: (ids, matrix). Bounded, so the driver may hold it."""
    draw = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(salt)), 11) / float(1 << 53)
    rows = vectors.where(draw < min(1.0, 0.95 * most / max(1, total))).limit(2 * most).toArrow()
    ids = rows.column("vec_id").to_numpy()
    order = np.argsort(ids)[:most]
    return ids[order], matrix(rows.column("vec"))[order]


def brute_force(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[tuple[int, float]]]:
    """The true k nearest rows of a bounded set of queries: the audit's ground truth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = unit(queries)
        for b in batches:
            if b.num_rows:
                a, v, s = nearest(q, ids, unit(matrix(b.column(1))), b.column(0).to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["q", "vec_id", "score"])

    from pyspark.sql import Window

    rows = vectors.select("vec_id", "vec").mapInArrow(run, "q long, vec_id long, score double")
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k)
    out: dict[int, list[tuple[int, float]]] = {int(i): [] for i in ids}
    for r in best.orderBy("q", "r").collect():
        out[r.q].append((r.vec_id, r.score))
    return out
