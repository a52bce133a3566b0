"""Fill-in-middle transformation: texts cut in three and written in another order, by DuckDB inside ``mapInArrow``.

Each Arrow batch is cut by bytes into slices, each registered with a DuckDB of one
thread that the task keeps. SQL takes the code points apart, draws both cuts and the
form from sha256 of seed and id, and puts the parts together again. No Python
runs per row. A task holds a batch, one slice and about 40 bytes for each code point of
the slice, which is ``SLICE`` bytes of text or one longer text. A row depends on its own
id and text alone, so a lost executor costs its partitions only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that DuckDB takes apart at a time; a longer text comes alone.
SLICE = 1 << 20
MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix string, middle string, suffix string, output string"


def _sql(seed: str, percent: int, spm: int, marks: tuple[str, str, str]) -> str:
    def lit(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    p, s, m = map(lit, marks)
    draws = ", ".join(f"('0x' || substr(d, {8 * i + 1}, 8))::UBIGINT AS h{i + 1}" for i in range(4))
    return f"""
    WITH named AS (SELECT doc_id, coalesce(text, '') AS text, sha256({lit(seed + ":")} || coalesce(doc_id::VARCHAR, '')) AS d FROM batch),
    units AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).') AS u, {draws} FROM named),
    counted AS (SELECT *, len(u)::UBIGINT AS n FROM units),
    cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
        CASE WHEN n = 0 OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR h3 % 100 >= {percent} THEN 'plain'
             WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM counted),
    parts AS (SELECT doc_id, text, n::BIGINT AS n, form,
        CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, a), '') END AS prefix,
        CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, a + 1, b), '') END AS middle,
        CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, b + 1, n::BIGINT), '') END AS suffix FROM cut)
    SELECT doc_id, n, form, prefix, middle, suffix,
        CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output
    FROM parts"""


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``most`` bytes of text, or of one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64)
    ends = np.cumsum(size)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def transform(docs: DataFrame, seed: str = "1", percent: int = 90, spm: int = 20, marks: tuple[str, str, str] = MARKS, slice_bytes: int = SLICE) -> DataFrame:
    """``(doc_id, n, form, prefix, middle, suffix, output)`` for each row of ``docs(doc_id, text, ...)``.

    Of n code points the prefix ends after the smaller of two draws from 0 to n, the middle
    after the larger. Form ``psm`` writes prefix, suffix, middle behind their marks, ``spm``
    (``spm`` in 100 of those transformed) suffix, prefix, middle. ``plain`` leaves the text
    as it is and has null parts: texts that are null (taken as empty), empty or hold a
    mark, and those beyond ``percent`` in 100. Draws come from sha256 of seed and id, a null id
    written as nothing; repeated ids draw alike. Very long texts are cut whole, by
    themselves. Other columns are ignored whatever their names; no rows give no rows.
    """
    sql = _sql(seed, percent, spm, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        con.execute("SET TimeZone = 'UTC'")
        kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), *[(c, pa.string()) for c in ("form", "prefix", "middle", "suffix", "output")]])
        for b in batches:
            for part in _slices(b, slice_bytes):
                con.register("batch", pa.Table.from_batches([part]))
                yield from con.execute(sql).to_arrow_table().cast(kind).to_batches()
                con.unregister("batch")
        con.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from an output and its form. Exact: a text that holds a mark is plain, and no mark begins as another ends."""
    p, s, m = marks
    out = F.col(output)
    middle, front = F.substring_index(out, m, -1), F.substring_index(out, m, 1)
    psm = F.concat(F.substring_index(F.expr(f"substring(`{output}`, {len(p) + 1})"), s, 1), middle, F.substring_index(front, s, -1))
    spm = F.concat(F.substring_index(front, p, -1), middle, F.substring_index(F.expr(f"substring(`{output}`, {len(s) + 1})"), p, 1))
    return F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", psm).otherwise(spm)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Digests of what :func:`transform` writes for every document, and of the text rebuilt from it."""
    told = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return told.select("doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP12_SQL = """
WITH named AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS d FROM documents),
drawn AS (SELECT doc_id, t, length(t) AS n, ('0x' || d[1:8])::UBIGINT AS h1, ('0x' || d[9:16])::UBIGINT AS h2, ('0x' || d[17:24])::UBIGINT AS h3, ('0x' || d[25:32])::UBIGINT AS h4 FROM named),
cut AS (SELECT *, CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1)::UBIGINT, h2 % (n + 1)::UBIGINT)::BIGINT AS a, greatest(h1 % (n + 1)::UBIGINT, h2 % (n + 1)::UBIGINT)::BIGINT AS b FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
                ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM cut
"""
