"""Hard negatives, fill-in-middle and sharding beside plain Python and DuckDB."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigloom.llm import middles, negatives, registry, shards

VECTORS = "vec_id long, embedding array<double>, label int, score long, anchor_id string, _r string, done string"


def plain_mine(data, every=50, positives=5, negs=3):
    """Brute force in Python integers."""
    rows = {}
    for i, x, label in data:
        if i is not None and label is not None and x and all(v is not None and math.isfinite(v) for v in x):
            rows[i] = min(rows.get(i, (([math.inf], 0))), ([math.floor(256 * v) for v in x], label))
    out = []
    for a in (i for i in rows if i % every == 0):
        va, la = rows[a]
        met = [(sum(p * q for p, q in zip(va, v)), i, lab) for i, (v, lab) in rows.items() if i != a and len(v) == len(va)]
        best = sorted((-s, i) for s, i, lab in met if lab == la)[:positives]
        for p, i in best:
            fit = sorted((-s, j) for s, j, lab in met if lab != la and 50 * -p <= 100 * s <= 95 * -p)[:negs]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(fit)]
    return sorted(out)


def table(spark, data):
    return spark.createDataFrame([(i, x, label, 1, "x", "x", "x") for i, x, label in data], VECTORS)


def mined(df, **more):
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, **more).collect())


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_fill_in_middle", "op13_sharding"])
def test_same_rows_as_sql(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    q = duck.execute(registry.SQL[name])
    columns = [d[0] for d in q.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, q.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


def test_negatives_on_ties_copies_and_odd_rows(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=6).tolist(), int(rng.integers(3))) for i in range(240)]
    data += [(1000 + i, [0.5, 0.25, 0.5, 0.0, 0.0, 0.0], 1) for i in range(150)]  # copies beyond any slack
    data += [(2000 + i, [0.4, 0.2, 0.4, 0.0, 0.0, 0.0], 2) for i in range(150)]
    data += [(-50, [0.5, 0.25, 0.5, 0.0, 0.0, 0.0], 1), (5000, [1.0, 2.0], 1), (5001, [1.0, 2.0], 1), (5002, [0.9, 1.6], 0), (5050, [0.0] * 6, 1)]
    data += [(5100, None, 1), (5101, [1.0] * 6, None), (None, [1.0] * 6, 1), (5102, [1.0, None], 1), (5103, [float("nan")] * 6, 1), (5104, [float("inf")] * 6, 0), (5105, [], 0)]
    data += [(7, data[7][1], data[7][2]), (8, [9.0] * 6, 0)]
    want = plain_mine(data)
    assert any(r[3] >= 2000 for r in want) and any(r[4] == 0 for r in want)
    assert mined(table(spark, data)) == want
    monkeypatch.setattr(negatives, "BUCKETS", 2)
    monkeypatch.setattr(negatives, "SLACK", 0)
    assert mined(table(spark, data[240:])) == plain_mine(data[240:])  # many digits, of scores and of ids


def test_negatives_of_few_rows_and_far_ids(spark):
    far = [((1 << 63) - 8, [1.0, 0.5], 0), (-(1 << 63) + 8, [1.0, 0.5], 1), (0, [1.0, 0.5], 0), (50, [1e5, 2e5], 0), (51, [5e4, 1e5], 1)]
    assert mined(table(spark, far)) == plain_mine(far)
    for data in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1e300], 1), (1, [1e300], 1)]):
        assert mined(table(spark, data)) == []


def test_counts_only_above_a_blocks_own_kth(spark):
    import pyarrow as pa

    rows = pa.table({"vec_id": pa.array(range(1, 2001)), "label": pa.array([1] * 2000, pa.int32()), "vec": pa.array([[i] for i in range(2000)], pa.list_(pa.int64()))})
    w = {"anchor_id": [0], "key": [0], "same": [True], "label": [1], "vec": [[1]], "low": [0], "high": [1999], "lo": [0], "hi": [1999], "id_lo": [1], "id_hi": [2000], "need": [5], "done": [False]}
    got = negatives._count((), rows, pa.table(w | {"label": pa.array([1], pa.int32()), "vec": pa.array([[1]], pa.list_(pa.int64()))}))
    assert got.num_rows <= 5 and sum(got.column("c").to_pylist()) >= 5


def plain_middle(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in middles.MARKS) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return (doc_id, n, "spm" if spm else "psm", p, m, s, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


def odd_texts():
    import random

    rng = random.Random(4)
    alphabet = "ab \n\t\r\0é日\U0001f600́‍<>PSM'\"\\"
    texts = [None, "", "a", "\n", "\0", "é‍\U0001f600", "<P>x", "x<M>", "<S", "<P" * 9, "S>" * 9, "'", "''", "x" * 70000, "\U0001f600" * 3000]
    return texts + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(600)]


@pytest.mark.parametrize("most", [64, 1 << 20])
def test_middles_are_the_plain_ones(spark, most):
    data = [(i, t, "x", "x", "x", "x") for i, t in enumerate(odd_texts())] + [(None, "no id", "x", "x", "x", "x"), (3, "again", "x", "x", "x", "x"), (3, "again", "x", "x", "x", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, batch string, d string, u string, output string")
    got = middles.transform(df, slice_bytes=most).withColumn("back", middles.restored()).collect()
    assert Counter(tuple(r)[:-1] for r in got) == Counter(plain_middle(i, t) for i, t, *_ in data)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t, *_ in data)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middles.transform(df.limit(0)).collect() == []


def test_marks_and_shares_are_parameters(spark):
    df = spark.createDataFrame([(i, f"it's a text of number {i}") for i in range(200)], "doc_id long, text string")
    marks = ("<pre'>", "<suf'>", "<mid'>")
    got = middles.transform(df, seed="it's", percent=100, spm=100, marks=marks).withColumn("back", middles.restored(marks=marks)).collect()
    assert {r.form for r in got} == {"spm"} and all(r.back == f"it's a text of number {r.doc_id}" for r in got)


def plain_shards(rows, count, seed="mixture"):
    by = {}
    for i, source in rows:
        by.setdefault(source, []).append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:12], i))
    u = lambda s: (2 * int(hashlib.md5(f"{seed}:{'' if s is None else '=' + s}".encode()).hexdigest()[:6], 16) + 1) / (1 << 25)
    placed = sorted(((k + u(s)) / len(g), "" if s is None else "=" + s, h, i) for s, g in by.items() for k, (h, i) in enumerate(sorted(g)))
    n = len(placed)
    return {p[3]: (r * count // n, r - -(-(r * count // n) * n // count)) for r, p in enumerate(placed)}


SHARD = "doc_id long, source string, text string, shard string, row string, _bin string, _rank string, n string"


@pytest.mark.parametrize("rows_a_bin", [16, 1 << 13])
def test_shards_are_the_plain_ones_and_match_the_mixture(spark, monkeypatch, rows_a_bin):
    monkeypatch.setattr(shards, "BIN_ROWS", rows_a_bin)
    of = lambda i: None if i % 97 == 0 else "hot" if i % 3 else f"s{i % 11}"
    data = [(i, of(i), None if i % 5 else "text", *["x"] * 5) for i in range(3000)]
    got = shards.interleave(spark.createDataFrame(data, SHARD), 40).collect()
    want = plain_shards([(i, of(i)) for i in range(3000)], 40)
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want
    assert len(got) == 3000 and all(r.row == r._bin == r._rank == r.n == "x" and r.law == "rows" and r.grown_shard is None for r in got)
    sizes, mix = Counter(r.shard for r in got), Counter((r.shard, r.source) for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in Counter(r.source for r in got).items():
        assert all(abs(mix[k, s] - n / 40) <= (2 if s != "hot" else 5) for k in range(40))


def test_sources_of_one_row_spread_over_all_shards(spark):
    data = [(i, "hot" if i < 1000 else f"s{i}", None, *["x"] * 5) for i in range(2000)]
    got = Counter(r.shard for r in shards.interleave(spark.createDataFrame(data, SHARD), 20).collect() if r.source == "hot")
    assert len(got) == 20 and min(got.values()) >= 30 and max(got.values()) <= 70


def test_shards_of_odd_tables(spark):
    make = lambda data: spark.createDataFrame([(i, s, t, *["x"] * 5) for i, s, t in data], SHARD)
    odd = [(None, None, None)] * 50 + [(None, "a", f"t{i}") for i in range(50)] + [(1, "a", "same")] * 30 + [(2, "", "x" * 100000)]
    got = shards.interleave(make(odd), 7).collect()
    assert Counter((r.doc_id, r.source, r.text) for r in got) == Counter(odd)
    for k, n in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n)) and n in (18, 19)
    assert shards.interleave(make([])).collect() == []
    assert sorted(r.shard for r in shards.interleave(make(odd[-3:]), 40).collect()) == [0, 13, 26]  # fewer rows than shards


def test_shard_files_hold_their_rows_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, "abc"[i % 3], "t", *["x"] * 5) for i in range(500)], SHARD)
    shards.write(shards.interleave(df, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r.shard for r in back.collect()) == {0: 125, 1: 125, 2: 125, 3: 125}
    one = [r.slot for r in spark.read.parquet(str(tmp_path / "out" / "shard=2")).collect()]
    assert sorted(one) == list(range(125))


def test_digest_columns_of_sharding(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in registry.QUERIES["op13_sharding"](spark, small).collect():
        text = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(text) + 16, zlib.crc32(text))
