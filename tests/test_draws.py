"""Exact draws against plain loops."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import draws as R


def digest(seed, key):
    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()


def greedy(sizes, capacity, seed):
    got, left = set(), capacity
    for g in sorted(sizes, key=lambda g: digest(seed, g)):
        if sizes[g] <= left:
            got.add(g)
            left -= sizes[g]
    return got, left


@pytest.fixture(scope="module")
def grouped(spark):
    """Groups of many sizes, one with a third of all rows."""
    rng = np.random.default_rng(3)
    sizes = {g: int(v) for g, v in enumerate(rng.integers(1, 40, 300))}
    sizes[300] = sum(sizes.values()) // 2
    rows = [(g, i) for g, n in sizes.items() for i in range(n)]
    return sizes, spark.createDataFrame([*rows, (None, 1)], "g int, i int").repartition(4)


@pytest.mark.parametrize("leaf", [1, 7, 4096])
def test_reserve_is_the_greedy_fill(grouped, monkeypatch, leaf):
    sizes, df = grouped
    monkeypatch.setattr(R, "LEAF", leaf)
    total = sum(sizes.values())
    for capacity in (0, 1, 37, total // 3, total // 2 + 11, total - 1, total, total + 5):
        want, left = greedy(sizes, capacity, "s")
        got = R.exact_reserve(df, "g", capacity, "s")
        told = got.groupBy("g", "reserved").count().collect()
        assert {r.g for r in told if r.reserved} == want
        assert sum(r["count"] for r in told if r.reserved) == capacity - left
        assert sum(r["count"] for r in told) == total + 1 and [r.reserved for r in told if r.g is None] == [False]


def test_reserve_edges(spark, grouped):
    sizes, df = grouped
    assert R.exact_reserve(df.limit(0), "g", 5, "s").collect() == []
    two = spark.createDataFrame([(1, 9)] * 3 + [(2, 9)] * 3, "g int, n int")  # a column named as one inside
    assert R.exact_reserve(two, "g", 3, "s", exact=True).where("reserved").count() == 3
    with pytest.raises(ValueError):
        R.exact_reserve(two, "g", 4, "s", exact=True)
    with pytest.raises(ValueError):
        R.exact_reserve(two, "g", -1, "s")


def most_groups(counts, size):
    return max(g for g in range(sum(counts) // size + 1) if sum(min(n, g) for n in counts) >= size * g)


@pytest.mark.parametrize("size, quota", [(4, None), (4, 3), (2, None), (1, None), (7, 20)])
def test_groups_are_as_many_as_can_be(spark, size, quota):
    rng = np.random.default_rng(size)
    counts = [*rng.integers(1, 25, 40).tolist(), 400]  # one source holds nearly half
    rows = [(s, 1000 * s + i) for s, n in enumerate(counts) for i in range(n)]
    df = spark.createDataFrame([*rows, (None, 5), (5, None)], "s int, k int").repartition(4)
    got = R.disjoint_groups(df, "s", "k", "d", size, quota).collect()
    want = most_groups([min(n, quota or n) for n in counts], size)
    assert len(got) == want * size and len({r.k for r in got}) == len(got)
    assert Counter(Counter(r.group_id for r in got).values()) == {size: want}
    assert len({(r.group_id, r.s) for r in got}) == len(got)  # no source twice
    given = Counter(r.s for r in got)
    assert max(given.values()) <= (quota or max(counts))
    for s, n in given.items():  # a source's first by digest
        assert {r.k for r in got if r.s == s} == set(sorted((k for t, k in rows if t == s), key=lambda k: digest("d", k))[:n])


def test_groups_without_enough_sources(spark):
    df = spark.createDataFrame([(1, i) for i in range(9)], "s int, k int")
    assert R.disjoint_groups(df, "s", "k", "d", 2).collect() == []
    assert R.disjoint_groups(df.limit(0), "s", "k", "d", 2).schema.names == ["s", "k", "group_id"]
    assert {r.group_id for r in R.disjoint_groups(df.where(F.col("k") < 3), "s", "k", "d", 1).collect()} == {0, 1, 2}
