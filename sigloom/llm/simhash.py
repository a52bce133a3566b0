"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit i is given a non-zero vector m(i) of GF(2)^(r+1). For each
of the 2^(r+1)-1 non-zero vectors v, table v keeps the bits with <m(i), v> = 1.
Any r bits give r equations in r+1 unknowns, so some v != 0 is orthogonal to
all bits in which two fingerprints differ: the pair collides in that table, with
certainty. A bucket that holds more than ``bucket`` fingerprints is covered anew
over the bits its table left out; each level halves those, so that in the end a
bucket can hold no more than 2^8 fingerprints. No pair is lost and none is listed:
a bucket gives a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .work import Workspace

RADIUS = 3
BUCKET = 512


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``bits`` such that any two words differing in at most ``radius`` of them agree under one."""
    top = 1 << (radius + 1)
    vec = {b: 1 + i % (top - 1) for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vec[b] & v).bit_count() & 1) for v in range(1, top)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of one text as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space only
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words))
    line = b" ".join(words)
    n = len(words) - k + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[s:e], 42) for s, e in zip(start[:n].tolist(), end[k - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``; fp is the fingerprint's bits as a signed long. A null text has none set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows of (members) -> links (a, b) that span the radius graph of each bucket."""
    for batch in batches:
        a, b = [], []
        for members in batch.column(0):
            fps = np.unique(np.array(members.as_py(), np.int64))
            bits = fps.view(np.uint64)
            label = np.arange(len(fps))
            for i in range(len(fps) - 1):
                near = np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= radius) + i + 1
                for j in near:
                    if label[i] != label[j]:
                        label[label == label[j]] = label[i]
                        a.append(fps[i])
                        b.append(fps[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _spread(df: DataFrame, tables: list[tuple[str, int]]) -> DataFrame:
    """One row per fingerprint and table: (tag, key, fp)."""
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in tables]))
    return df.select("fp", rows.alias("x")).select("x.tag", "x.key", "fp")


def links(ws: Workspace, fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) over distinct ``fps(fp)`` that span all pairs within ``radius`` bits."""
    tables = {f"{v}": (m, [i for i in range(64) if not m >> i & 1]) for v, m in enumerate(covering_masks(list(range(64)), radius))}
    rows = _spread(fps, [(t, m) for t, (m, _) in tables.items()])
    found = []
    while True:
        counts = rows.groupBy("tag", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        counts = ws.table(counts)
        full = [r.tag for r in counts.where(F.col("n") > bucket).select("tag").distinct().collect()]  # tags: bounded by the tables
        full = [t for t in full if len(tables[t][1]) > 8]
        fine = F.col("n") <= bucket if full else F.lit(True)
        if full:
            fine = fine | ~F.col("tag").isin(full)
        small = rows.join(counts.where(fine).select("tag", "key"), ["tag", "key"])
        lists = small.groupBy("tag", "key").agg(F.collect_set("fp").alias("m")).select("m")
        found.append(ws.table(lists.mapInArrow(lambda it: _forest(it, radius), "a long, b long").distinct()))
        if not full:
            break
        hot = rows.join(counts.where(~fine).select("tag", "key"), ["tag", "key"])
        finer, masks = {}, []
        for t in full:
            mask, free = tables[t]
            for v, m in enumerate(covering_masks(free, radius)):
                finer[f"{t}.{v}"] = (mask | m, [i for i in free if not m >> i & 1])
                masks.append((t, f"{t}.{v}", _signed(mask | m)))
        # at most 15 rows for each table of the level before, of which there are 15, 225 or 3,375
        known = F.broadcast(fps.sparkSession.createDataFrame(masks, "tag string, finer string, mask long"))
        rows = hot.select("tag", "fp").distinct().join(known, "tag").select(F.col("finer").alias("tag"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        rows, tables = ws.table(rows), finer
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs(doc_id, text, ...)``.

    component_id is the smallest doc_id that links reach; two fingerprints link at
    ``radius`` or fewer differing bits. Null and blank texts have fingerprint zero
    and link like any other. A row with a null doc_id keeps a null component_id of
    its own unless a doc with an id shares its fingerprint's component. Repeated
    doc_ids give repeated rows; other columns are ignored; no rows give no rows.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    each = ws.table(fingerprints(docs, shingle))
    classes = ws.table(each.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    pairs = links(ws, classes.select("fp"), radius, bucket)
    comps = connected_components(ws, pairs)
    by_fp = classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = by_fp.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = by_fp.join(least, "component").select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
