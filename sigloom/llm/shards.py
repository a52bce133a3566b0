"""Sharding by proportional stratified interleaving, in DataFrame functions alone.

Rows of each source are shuffled by a seeded digest and ranked; rank k of n stands at the
fraction (k + u) / n. u, from 0 to 1, is the source's own, by digest: with 1/2 for all,
sources of one size would stand at the same fractions, and those of one row all in the
middle. In the order of fractions every stretch holds the sources in their proportions,
so that cutting it into equal runs gives shards that each match the mixture.

Neither rank takes a sort in one task. Digests are uniform, so a source is ranked in bins of
its digest side by side; a small table of (source, bin) counts carries the ranks over. The
order of fractions is ranked in bins likewise. A source with a third of all rows
spreads over all bins. Bins change the plan, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import Workspace

SHARDS = 40
SEED = "mixture"
#: Rows that a bin aims at, and the most bins there can be (as a power of two).
BIN_ROWS, MOST_BITS = 1 << 10, 20


def _ranked(rows: DataFrame, key: str, bin_: str, order: list[Column], ws: Workspace) -> DataFrame:
    """``rows`` with ``_rank``, from 0 within ``key`` by bin and then ``order``, and ``_n``, the rows of the key. Keys are not null."""
    counts = ws.table(rows.groupBy(key, bin_).agg(F.count(F.lit(1)).alias("_c")))
    # a row for each bin of a key, 2^20 at most
    all_ = Window.partitionBy(key)
    before = F.coalesce(F.sum("_c").over(all_.orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = counts.select(key, bin_, before.alias("_before"), F.sum("_c").over(all_).alias("_n"))
    numbered = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key, bin_).orderBy(*order)))
    return numbered.join(carried, [key, bin_]).withColumn("_rank", F.col("_before") + F.col("_nth") - 1)


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``docs(doc_id, source, ...)`` with ``law`` (``rows``), ``shard``, ``slot`` (from 0, without gaps) and ``grown_shard`` (null).

    Shards differ by one row at most. A shard holds a source's rows in its proportion, give
    or take a row, and as far as the others' rows in the same stretch do. A null source is a source. Rows are shuffled by digest of seed and
    id; null ids and repeated ids are told apart by a hash of the whole row, and rows alike in
    everything change places freely. Fewer rows than shards leave shards empty; no rows
    give no rows. Columns of ``docs`` named as those added are replaced. Whole rows go through
    two shuffles: hand over ids and sizes where texts need not move.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    ws = Workspace(docs.sparkSession, "shards")
    # digests stand in for rows without an id, so that they spread over the bins too
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), whole.cast("string")))
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named)), 1, 12), 16, 10).cast("long")
    kept = [c for c in docs.columns if c not in ("law", "shard", "slot", "grown_shard")]
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = ws.table(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), source.alias("_source"), F.col("doc_id").cast("long").alias("_id"), digest.alias("_digest"), whole.alias("_hash")))
    total = rows.count()
    bits = min(MOST_BITS, max(0, (total // BIN_ROWS).bit_length()))
    own = ["_digest", "_id", "_hash"]
    ranked = _ranked(rows.withColumn("_bin", F.shiftright("_digest", 48 - bits)), "_source", "_bin", [F.col(c) for c in own], ws)
    u = (2 * F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "_source")), 1, 6), 16, 10).cast("long") + 1) / float(1 << 25)
    placed = ranked.select("row", "_source", *own, ((F.col("_rank") + u) / F.col("_n")).alias("_at"))
    placed = ws.table(placed.withColumn("_bin", F.floor(F.col("_at") * (1 << bits))).withColumn("_all", F.lit(0)))
    final = _ranked(placed, "_all", "_bin", [F.col(c) for c in ("_at", "_source", *own)], ws)
    at = F.col("_rank")
    shard = F.expr(f"(_rank * {shards}L) div {max(1, total)}L")
    told = final.select("row", at, shard.alias("_shard"))
    first = F.expr(f"(_shard * {total}L + {shards - 1}L) div {shards}L")
    return told.select("row.*", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"), (at - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write(sharded: DataFrame, path: str) -> None:
    """Shards as folders of Parquet files, rows in order of their slots. One that is lost while written is written anew."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("errorifexists").partitionBy("shard").parquet(path)


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard, by :func:`interleave` over ids, sources, sizes and digests of texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    slim = docs.select("doc_id", "source", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return interleave(slim).select("doc_id", "source", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP13_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
hexed AS (SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
summed AS (SELECT doc_id, source, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM hexed, crc),
drawn AS (SELECT *, md5('mixture:' || doc_id) AS d FROM summed),
ranked AS (SELECT *, ('0x' || substr(d, 1, 12))::BIGINT AS h, row_number() OVER (PARTITION BY source ORDER BY substr(d, 1, 12), doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM drawn),
shifted AS (SELECT *, (2 * ('0x' || substr(md5('mixture:' || coalesce('=' || source, '')), 1, 6))::BIGINT + 1)::DOUBLE / 33554432 AS u FROM ranked),
placed AS (SELECT *, row_number() OVER (ORDER BY (k + u) / n::DOUBLE, source NULLS FIRST, h, doc_id) - 1 AS r, count(*) OVER () AS total FROM shifted)
SELECT doc_id, source, size::BIGINT AS size, text_crc32, 'rows' AS law, (r * 40 // total)::INTEGER AS shard,
    (r - ((r * 40 // total) * total + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM placed
"""
