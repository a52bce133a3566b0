"""Substring dedup by level-wise doubling of repeated word windows.

The levels of a window of 20 words are 5, 10 and 20. A window is stood for by
its anchor: the 5 consecutive words in it whose hash is least (leftmost of
equals). Equal windows have the same anchor at the same offset, so a window can
only repeat if its anchor does, and an eighth of all positions is enough for
the first level. Anchors that repeat are extended to twice their length, to the
right and to the left; those whose extension repeats too are extended to the
whole windows around them, and these alone are compared in full, by 96 bits.
Where no candidate survives a level, the ladder ends.

Counts are combined before each shuffle; candidates meet the counts in joins
that Spark can split, and windows are reduced to the first of each within a task
before they are dealt by hash, so no frequent passage gathers in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import Workspace

WINDOW = 20
#: Windows compared at a time within a task.
HELD = 1 << 20
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_M = np.uint64(0xFF51AFD7ED558CCD)
_S = np.uint64(32)


def words_of(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hash(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _M
    return h ^ (h >> _S)


def _grams(w: np.ndarray, base: int, c: np.uint64) -> list[np.ndarray]:
    """Hashes of all windows of base, 2 base and 4 base words, each from two of the length before."""
    n = len(w) - base + 1
    h, power = np.zeros(n, np.uint64), np.uint64(1)
    for i in range(base):
        h += w[i : i + n] * power
        power *= c
    out = [h]
    for k in (1, 2):
        a, step = out[-1], base * k
        out.append(a[:-step] + power * a[step:])
        power *= power
    return out


def _anchors(h: np.ndarray, reach: int) -> np.ndarray:
    """For each window, where its least hash among ``reach`` stands."""
    return np.arange(len(h) - reach + 1) + np.lib.stride_tricks.sliding_window_view(h, reach).argmin(1)


def _batch(columns: dict[str, list[np.ndarray]], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.empty(0, np.int64)).cast(types[k]) for k, v in columns.items()], names=list(columns))


def _first_level(window: int):
    base = window // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"h": pa.int64(), "doc_id": pa.int64(), "pos": pa.int32(), "sides": pa.int64()}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in types}
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if len(words) < window:
                    continue
                with np.errstate(over="ignore"):
                    one, two, _ = _grams(_hash(words), base, _C1)
                    one, two = _mix(one), _mix(two)
                at = np.unique(_anchors(one, window - base + 1))
                right, left = np.minimum(at, len(two) - 1), np.maximum(at - base, 0)
                out["h"].append(one[at].view(np.int64))
                out["pos"].append(at)
                # beside h, half a hash tells extensions apart: 96 bits in all
                out["sides"].append(((two[right] >> _S << _S) | (two[left] >> _S)).view(np.int64))
                out["doc_id"].append(np.full(len(at), doc))
                held += len(at)
                if held > HELD:
                    yield _batch(out, types)
                    out, held = {k: [] for k in out}, 0
            yield _batch(out, types)

    return run


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted starts of each document -> runs (doc, lo, hi), hi included."""
    cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(start) != 1)) + 1 if len(doc) else np.empty(0, np.int64)
    lo = np.concatenate([[0], cut]).astype(np.int64)[: len(doc)]
    hi = np.concatenate([cut - 1, [len(doc) - 1]]).astype(np.int64)[: len(doc)]
    return doc[lo], start[lo], start[hi]


def _last_level(window: int):
    base = window // 4

    def settle(h1, h2, doc, start) -> pa.RecordBatch:
        """The first of each window goes on; the others of it are known to repeat."""
        h1, h2, doc, start = map(np.concatenate, (h1, h2, doc, start))
        order = np.lexsort((start, doc, h2, h1))
        h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        least = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        late = (doc != doc[least]) | (start != start[least])
        d, s = doc[late], start[late]
        order = np.lexsort((s, d))
        rd, lo, hi = _runs(d[order], s[order])
        k, m = int(new.sum()), len(rd)
        cols = [
            pa.concat_arrays([pa.array(h1[new].view(np.int64)), pa.nulls(m, pa.int64())]),
            pa.concat_arrays([pa.array(h2[new].view(np.int32)), pa.nulls(m, pa.int32())]),
            pa.array(np.concatenate([doc[new], rd])),
            pa.array(np.concatenate([start[new], lo]).astype(np.int32)),
            pa.array(np.concatenate([start[new], hi]).astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["h1", "h2", "doc_id", "lo", "hi"]) if k + m else pa.RecordBatch.from_arrays([c.slice(0, 0) for c in cols], names=["h1", "h2", "doc_id", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], [], []), 0
        for batch in batches:
            for doc, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = words_of(text)
                if len(words) < window:
                    continue
                w = _hash(words)
                with np.errstate(over="ignore"):
                    one, _, h1 = _grams(w, base, _C1)
                    h2 = (_mix(_grams(_mix(w ^ _C2), base, _C2)[2]) >> _S).astype(np.uint32)
                    one, h1 = _mix(one), _mix(h1)
                m = marks.values.to_numpy(zero_copy_only=False)
                right, left = np.zeros(len(one), bool), np.zeros(len(one), bool)
                at = m >> 2
                fits = at < len(one)
                right[at[fits & (m & 1 > 0)]] = True
                left[at[fits & (m & 2 > 0)]] = True
                a = _anchors(one, window - base + 1)
                # the right extension lies inside the window up to this offset, the left one beyond it
                p = np.flatnonzero(np.where(a - np.arange(len(a)) <= window - 2 * base, right[a], left[a]))
                for to, x in zip(held, (h1[p], h2[p], np.full(len(p), doc), p)):
                    to.append(x)
                size += len(p)
                if size > HELD:
                    yield settle(*held)
                    held, size = ([], [], [], []), 0
        if size:
            yield settle(*held)

    return run


def removals(ws: Workspace, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, runs array<struct<lo, hi>>)``: starts of the windows that also start earlier."""
    spark = docs.sparkSession
    named = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    none = spark.createDataFrame([], "doc_id long, runs array<struct<lo:int,hi:int>>")
    anchors = ws.table(named.mapInArrow(_first_level(window), "h long, doc_id long, pos int, sides long"))
    # counts are written first: Spark can split a frequent anchor's rows only where both sides of a join are plain tables
    often = ws.table(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    ws.sweep()
    second = ws.table(anchors.join(often, "h", "left_semi").select("h", "doc_id", "pos", "sides"))
    ws.drop(anchors, often)
    if second.isEmpty():
        return none
    side = lambda k, g: F.struct(F.lit(k).alias("side"), g.cast("int").alias("g"))
    both = F.array(side(1, F.shiftright("sides", 32)), side(2, F.shiftright(F.shiftleft("sides", 32), 32)))
    longer = second.select("h", "doc_id", "pos", F.explode(both).alias("x")).select("h", "x.side", "x.g", "doc_id", "pos")
    often = ws.table(longer.groupBy("h", "side", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    third = longer.join(often, ["h", "side", "g"], "left_semi")
    marks = ws.table(third.groupBy("doc_id").agg(F.array_distinct(F.collect_list(F.shiftleft("pos", 2) + F.col("side"))).alias("marks")))
    ws.drop(second, often)
    if marks.isEmpty():
        return none
    found = ws.table(named.join(marks, "doc_id").select("doc_id", "text", "marks").mapInArrow(_last_level(window), "h1 long, h2 int, doc_id long, lo int, hi int"))
    ws.drop(marks)
    whole = found.where("h1 is not null").select("h1", "h2", "doc_id", "lo")
    # a window has a row of each task that held it at most, so its group is bounded by the tasks
    order = Window.partitionBy("h1", "h2").orderBy("doc_id", "lo")
    first = whole.select("doc_id", "lo", F.first("doc_id").over(order).alias("d"), F.first("lo").over(order).alias("p"))
    late = first.where("doc_id != d or lo != p").select("doc_id", "lo", F.col("lo").alias("hi"))
    runs = late.union(found.where("h1 is null").select("doc_id", "lo", "hi"))
    out = ws.table(runs.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")))
    ws.drop(found)
    return out


def cut(docs: DataFrame, runs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed and kept (null where nothing was removed) added."""
    taken = docs.drop("n_words", "n_removed", "kept")
    names = taken.columns
    row = taken.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    joined = row.join(runs, "doc_id", "left").select("row", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            total, gone, kept = [], [], []
            for text, marks in zip(rows.field(names.index("text")).to_pylist(), batch.column(1)):
                words = words_of(text)
                total.append(len(words))
                if not marks.is_valid:
                    gone.append(0)
                    kept.append(None)
                    continue
                cover = np.zeros(len(words) + window + 1, np.int32)
                lo, hi = (marks.values.field(i).to_numpy() for i in (0, 1))
                inside = lo < len(words)
                np.add.at(cover, lo[inside], 1)
                np.add.at(cover, np.minimum(hi[inside] + window, len(words)), -1)
                keep = np.cumsum(cover)[: len(words)] == 0
                gone.append(int(len(words) - keep.sum()))
                kept.append(b" ".join(w for w, k in zip(words, keep.tolist()) if k).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([rows, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])

    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    schema = T.StructType([joined.schema["row"], *more])
    return joined.mapInArrow(run, schema).select("row.*", "n_words", "n_removed", "kept")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each row of ``docs(doc_id, text, ...)`` with n_words, n_removed and kept.

    A word goes if a window of ``window`` words covers it whose word sequence also
    starts earlier: at a smaller doc_id, or earlier in the same document. kept holds
    the other words joined by one space, or null where none was removed. A null
    text has no words. Rows with a null doc_id neither lose words nor count as
    copies. Rows that share a doc_id are one document; starts found in one of them
    apply to all. ``window`` must be a multiple of 4.
    """
    if window % 4 or window < 4:
        raise ValueError("the window must be a multiple of 4")
    ws = Workspace(docs.sparkSession, "substrings")
    return cut(docs, removals(ws, docs, window), window)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, kept = b.column(1).to_pylist(), b.column(2).to_pylist()
            sha = [hashlib.sha256(b" ".join(words_of(t)) if k is None else k.encode("utf-8", "surrogatepass")).hexdigest() for t, k in zip(text, kept)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "kept", "n_words", "n_removed").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
