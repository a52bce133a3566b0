"""From raw documents to packed training sequences, in five stages.

Each stage reads what the one before kept. All but the last return the columns of
``documents``; texts they change have a new n_chars. ``run`` writes the
result of every stage as Parquet and reads it again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm import langid, packing, pii, simhash, substrings
from sigloom.llm.work import Workspace

#: Documents go whose language no class reaches with this mean probability.
LEAST_SCORE = 0.3
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with n_chars of the text as it is now."""
    kind = docs.schema["n_chars"].dataType if "n_chars" in columns else None
    return docs.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language the network knows: null texts, texts without a letter and doubtful ones go.

    Repeated rows are each judged. Where no language is given to learn from, all documents stay.
    """
    model = langid.train(langid.training_sample(docs))
    labelled = langid.label(docs, model)
    sure = F.lit(True) if model is None else (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return labelled.where(sure).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays, once. Rows without an id stay."""
    named = docs.where("doc_id is not null")
    found = simhash.near_duplicates(named)
    keep = Workspace(spark, "kept").table(found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct())
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    stay = named.join(keep, F.col("doc_id") == F.col("_kept"), "left_semi").withColumn("_nth", one).where("_nth = 1")
    return stay.select(*[f"`{c}`" for c in docs.columns]).union(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that start earlier go; so do documents of which nothing is left.

    Null and empty texts have no words and stay. Of passages in repeated rows the one in the
    smaller doc_id stays; an empty table stays empty.
    """
    out = substrings.remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")
    return _with_text(out.withColumn("text", F.coalesce("kept", "text")), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets. Null and empty texts stay, as do repeated rows; an empty table stays empty."""
    return _with_text(pii.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids as 32-bit little-endian numbers.

    A null or empty text is its end id alone; repeated rows are packed one by one; an empty table gives no pieces.
    """
    return packing.pack(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("PII", personal_data),
    ("packing", pack),
]
#: The network, the fingerprints' components and the differencing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: pieces with their sequences, offsets and ids. No documents give no pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
