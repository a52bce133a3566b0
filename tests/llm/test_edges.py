"""Every operator over nulls, blanks, long texts, repeats, clashing columns and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sigloom.llm import bpe, langid, lmscore, neighbours, packing, pii, simhash, substrings, templates, vecdedup

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, runs string, component_id string, target string, h string, start string, length string"


def rows(*texts):
    return [(i, t, "en", "s", len(t or ""), *["x"] * 8) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    words = " ".join(f"w{i % 997}" for i in range(30000))
    data = rows((1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "é  x"), (6, "same text here for all"), (6, "same text here for all"), (7, "same text here for all"), (8, words), (9, words), (None, "no id at all"), (10, "x" * 50000), (11, "9" * 5000), (12, "\U0001f600 a@b.co"))
    return spark.createDataFrame(data + [(13, "text", None, None, None, *[None] * 8)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pages(df):
    return df.select(F.col("doc_id").alias("page_id"), F.lit("http://h.example/x").alias("url"), F.col("text").alias("html"), "lang", "row", "n_chars")


OPERATORS = {
    "pii": lambda d: pii.find(d),
    "redact": lambda d: pii.redact(d),
    "substrings": lambda d: substrings.remove_repeats(d),
    "templates": lambda d: templates.extract(pages(d)),
    "packing": lambda d: packing.pack(d, BYTES),
    "langid": lambda d: langid.identify(d, steps=60),
    "bpe": lambda d: bpe.digests(d, WORDS),
    "encode": lambda d: bpe.decode(bpe.encode(d, WORDS), WORDS),
    "lmscore": lambda d: lmscore.score(d, d.where("doc_id < 7")),
    "simhash": lambda d: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_are_each_answered(odd, name):
    got = OPERATORS[name](odd).collect()
    if name == "packing":
        assert sorted({r.doc_id for r in got if r.doc_id is not None}) == [*range(1, 14)]
        assert sum(r.start == 0 for r in got) == odd.count()
    else:
        assert len(got) == odd.count()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(none, name):
    assert OPERATORS[name](none).collect() == []


def test_defined_results(odd):
    n = {r.doc_id: r for r in substrings.remove_repeats(odd).collect()}
    assert (n[1].n_words, n[2].n_removed, n[9].n_removed, n[8].n_removed > 0) == (0, 0, 30000, True)
    lang = {r.doc_id: r for r in langid.identify(odd, steps=60).collect()}
    assert all(lang[i].lang_pred == "und" and lang[i].score == 0 for i in (1, 2, 3, 11))
    score = {r.doc_id: r for r in lmscore.score(odd, odd.where("doc_id < 7")).collect()}
    assert score[1].score is None and score[1].n_tokens == 0 and score[6].score is not None
    fp = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert fp[1].fingerprint == "0" * 16 and fp[1].component_id == fp[3].component_id == 1 and fp[7].component_id == 6
    ids = {r.doc_id: r for r in bpe.digests(odd, WORDS).collect()}
    assert ids[1].n_tokens == ids[3].n_tokens == 0


VECTORS = "vec_id long, embedding array<float>, label int, vec string, n string, copies string"


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [], 1), (2, [0.9, 0.1], 2), (None, [1.0, 1.0], 1), (100, [0.0, 1.0], None), (9, [1.0, 2.0, 3.0], 1), (150, [1.0, 2.0, 3.5], 1)]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in data], VECTORS)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.search(df).collect())
    assert got == [(0, 1, 50), (0, 2, 2), (0, 3, 100), (50, 1, 0), (50, 2, 2), (50, 3, 100), (100, 1, 2), (100, 2, 0), (100, 3, 50), (150, 1, 9)]
    out = vecdedup.near_duplicates(df).collect()
    assert len(out) == len(data)
    by = {r.vec_id: r for r in out}
    assert (by[0].n_links, by[50].n_links, by[2].n_links, by[100].n_links, by[4].n_links) == (2, 2, 2, 0, 0)
    assert {by[i].component_id for i in (0, 50, 2)} == {0} and by[3].kept and not by[50].kept and by[0].kept
    empty = df.limit(0)
    assert neighbours.search(empty).count() == 0 and vecdedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("name", ["language ID", "SimHash near-dedup", "substring dedup", "PII", "packing"])
def test_stages_on_odd_and_empty_tables(odd, none, small, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(odd.sparkSession, odd, small)
    rows = got.collect()
    if name != "packing":
        assert got.columns == odd.columns
    if name in ("PII", "substring dedup"):
        assert {r.doc_id for r in rows} >= {1, 2, 3, 4, 5, 6, 8, 10, 11, 12, 13, None}
    if name == "SimHash near-dedup":
        assert sorted(r.doc_id for r in rows if r.doc_id in (6, 7, 8, 9)) == [6, 8]
    if name == "packing":
        assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0) and all(len(r.ids) == 4 * r.length for r in rows)
    assert stage(odd.sparkSession, none, small).collect() == []
