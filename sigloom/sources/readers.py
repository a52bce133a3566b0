"""Readers: binary array files, label text, all-text tables and review logs, as typed tables.

Array files are landed once as Parquet rows with an array column; everything else
reads that. Bad rows are kept apart with a reason, not dropped.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import to_bool, to_count, to_float

TRACES = "path string, class string, stem string, size long, sha256 string, dtype string, n int, finite_fraction double, least double, most double, mean double, std double, signal array<double>, load_error string"


def parse_npy(content: bytes) -> np.ndarray:
    """An array from the bytes of a version 1 to 3 array file; objects are refused."""
    if content[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    wide = content[6] >= 2
    size = int.from_bytes(content[8 : 12 if wide else 10], "little")
    at = 12 if wide else 10
    head = ast.literal_eval(content[at : at + size].decode("utf-8" if content[6] >= 3 else "latin-1"))
    kind = np.dtype(head["descr"])
    if kind.hasobject:
        raise ValueError("object arrays are not read")
    a = np.frombuffer(content, kind, int(np.prod(head["shape"], dtype=np.int64)), at + size)
    return a.reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Every ``.npy`` file under a folder as one row, with its inventory; ``class`` is the folder's name.

    A file that can't be read, is not one-dimensional or is empty has a load_error and no signal.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    names = [f.name for f in T.StructType.fromDDL(TRACES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), *[pa.float64()] * 5, pa.list_(pa.float64()), pa.string()]
        for b in batches:
            rows = []
            for where, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = where.rstrip("/").split("/")
                row: dict = dict.fromkeys(names) | {"path": where, "class": parts[-2] if len(parts) > 1 else "", "stem": parts[-1].removesuffix(".npy"), "size": len(content), "sha256": hashlib.sha256(content).hexdigest()}
                try:
                    a = np.squeeze(parse_npy(content))
                    if a.ndim != 1 or not a.size:
                        raise ValueError(f"shape {a.shape} is not one-dimensional")
                    x = a.astype(np.float64)
                    good = x[np.isfinite(x)]
                    row |= {"dtype": str(a.dtype), "n": a.size, "finite_fraction": good.size / a.size, "signal": x}
                    if good.size:
                        row |= {"least": good.min(), "most": good.max(), "mean": good.mean(), "std": good.std()}
                except (ValueError, SyntaxError, KeyError, TypeError) as e:
                    row["load_error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    return files.select("path", "content").mapInArrow(run, TRACES)


def noise_chunks(traces_: DataFrame, length: int, keep_short: bool) -> DataFrame:
    """Complete chunks of ``length`` samples; a shorter trace is one chunk if ``keep_short``, else none."""
    n = F.size("signal")
    count = F.floor(n / length).cast("int")
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i * length))
    starts = starts.when(F.lit(keep_short), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    cut = traces_.where("signal is not null").select("path", "signal", F.posexplode(starts).alias("chunk", "start"))
    return cut.select("path", "chunk", F.slice("signal", F.col("start") + 1, F.lit(length)).alias("signal"))


def table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A headed comma-separated file with every column as text; missing required columns are an error."""
    out = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if missing := sorted(set(required) - set(out.columns)):
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return out


def typed(df: DataFrame, kinds: dict[str, str], strict: bool = False) -> DataFrame:
    """Text columns to floats, counts or booleans; blanks and non-finite values become null."""
    parse = {"float": lambda c: to_float(c), "bool": lambda c: to_bool(c, strict), "count": lambda c: to_count(c, strict)}
    return df.withColumns({c: parse[k](F.col(c)) for c, k in kinds.items()})


def labels(spark: SparkSession, path: str, classes: list[str], n: int, exact: bool = True) -> DataFrame:
    """Label text files, ``class center width`` a line, as half-open sample intervals with the file's stem.

    Rows that are malformed, of an unknown class or out of range have a ``problem`` and no interval. ``exact``
    refuses lines of more than three fields. Empty files give no rows: join from the traces' side.
    """
    lines = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(path)
    raw = lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("stem"), F.trim("value").alias("line")).where("line != ''")
    f = F.split("line", r"\s+")
    k, c, w = F.get(f, F.lit(0)).try_cast("int"), to_float(F.get(f, F.lit(1))), to_float(F.get(f, F.lit(2)))
    start, end = F.rint((c - w / 2) * n).cast("int"), F.rint((c + w / 2) * n).cast("int")
    slack = 1e-3 / n
    short = (F.size(f) != 3) if exact else (F.size(f) < 3)
    problem = F.when(short, "fields").when(k.isNull() | c.isNull() | w.isNull(), "not numbers").when((k < 0) | (k >= len(classes)), "unknown class").when((c - w / 2 < -slack) | (c + w / 2 > 1 + slack), "out of range").when(start >= end, "empty interval")
    names = F.array(*map(F.lit, classes))
    good = problem.isNull()
    return raw.select("stem", "line", problem.alias("problem"), F.when(good, k).alias("class_id"), F.when(good, F.get(names, k)).alias("class"), F.when(good, F.greatest(F.lit(0), start)).alias("start"), F.when(good, F.least(F.lit(n), end)).alias("end"))


def guarded(df: DataFrame, guard: int, n: int) -> DataFrame:
    """Intervals widened by a guard on both sides, within the trace."""
    return df.withColumn("start", F.greatest(F.lit(0), F.col("start") - guard)).withColumn("end", F.least(F.lit(n), F.col("end") + guard))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log with one JSON value a line; a line that does not fit is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def nested_document(spark: SparkSession, path: str, schema: str, items: str) -> DataFrame:
    """The elements of an array in one JSON document for each file."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode_outer(items).alias("item")).select("item.*")


def intervals_by_key(df: DataFrame, key: str) -> DataFrame:
    """Distinct intervals of each key, in order, as one array."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("intervals"))


def must_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a left row without a partner is an error."""
    marked = left.join(right.withColumn("_found", F.lit(True)), keys, "left")
    check = F.when(F.col("_found"), True).otherwise(F.raise_error(F.concat(F.lit("no match for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))).cast("boolean"))
    return marked.where(check).drop("_found")
