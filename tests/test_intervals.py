from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigloom.functions import expr as X
from sigloom.operators import intervals as I


def spans(spark, *pairs):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in pairs], "k int, start double, end double")


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_sweep(spark):
    out = got(I.sweep(spans(spark, (1, 9), (2, 4), (3, 12), (20, 21)), ["k"]), "start", "end", "active")
    assert out == [(1, 2, 1), (2, 3, 2), (3, 4, 3), (4, 9, 2), (9, 12, 1), (20, 21, 1)]


def test_merge_clips_and_joins_what_touches(spark):
    assert got(I.merge(spans(spark, (-2, 3), (2, 6), (6, 8), (15, 90)), ["k"], n=F.lit(40)), "start", "end") == [(0.0, 8.0), (15.0, 40.0)]
    assert got(I.merge(spans(spark, (0, 5), (5, 7)), ["k"]), "start", "end") == [(0.0, 7.0)]


def test_expand(spark):
    assert got(I.expand(spans(spark, (10, 20), (22, 24)), ["k"], 3, 2, F.lit(40)), "start", "end") == [(7.0, 26.0)]


def test_midpoint(spark):
    out = got(I.split_at_midpoints(spans(spark, (0.10, 0.30), (0.24, 0.42)), ["k"]), "new_start", "new_end")
    assert [tuple(round(v, 9) for v in r) for r in out] == [(0.10, 0.27), (0.27, 0.42)]


def test_midpoint_drops_narrow(spark):
    # 0.16 to 0.22 would be left of the first in a millisecond trace: 0.10..0.17, as 0.07 ms below 0.08
    out = I.split_at_midpoints(spans(spark, (0.10, 0.22), (0.12, 0.40)), ["k"], 0.08)
    assert sorted(r.kept for r in out.collect()) == [False, True]


def test_strict_overlap(spark):
    df = spans(spark, (0, 5), (10, 20), (25, 30)).where(~X.overlaps(F.col("start"), F.col("end"), F.lit(12), F.lit(18)))
    assert got(df, "start") == [(0.0,), (25.0,)]


def test_zero_runs(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0, 7.0, 0.0, 8.0, 0.0, 0.0, 0.0],)], "x array<double>")
    assert df.select(I.long_zero_runs_removed(F.col("x"), 3)).first()[0] == [0, 0, 0, 7, 0, 8, 0, 0, 0]


def test_crops(spark):
    df = spark.createDataFrame([([5.0, 6.0, 7.0, 8.0, 9.0, 10.0],)], "x array<double>")
    crop = lambda c: df.select(X.padded_crop(F.col("x"), F.lit(c), 5)).first()[0]
    assert crop(1) == [0, 5, 6, 7, 8]
    assert crop(5) == [8, 9, 10, 0, 0]
    assert df.select(X.clamped_crop(F.col("x"), F.lit(5), 3)).first()[0] == [8, 9, 10]


def test_subtract(spark):
    df = spark.sql("select struct(0D as start, 10D as end) as i, array(struct(-1D as start, 2D as end), struct(4D as start, 5D as end), struct(9D as start, 12D as end)) as u")
    assert [tuple(r) for r in df.select(I.subtract(F.col("i"), F.col("u"))).first()[0]] == [(2, 4), (5, 9)]


def test_complement(spark):
    out = I.complement(spans(spark, (2, 3), (5, 7)), ["k"], F.lit(0.0), F.lit(10.0))
    assert got(out, "start", "end") == [(0.0, 2.0), (3.0, 5.0), (7.0, 10.0)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 10)), min_size=1, max_size=20))
def test_merge_covers_the_same_points(spark, pairs):
    out = got(I.merge(spans(spark, *[(a, a + n) for a, n in pairs]), ["k"]), "start", "end")
    assert {i for a, b in out for i in range(int(a), int(b))} == {i for a, n in pairs for i in range(a, a + n)}
    assert all(b < c for (_, b), (c, _) in zip(out, out[1:]))


def test_expressions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert one(X.to_float(F.lit("nan"))) is None and one(X.to_float(F.lit("x"))) is None and one(X.to_float(F.lit(" 2.5 "))) == 2.5
    assert one(X.hull_iou(F.lit(0), F.lit(4), F.lit(2), F.lit(8))) == 0.25
    assert round(one(X.union_iou(F.lit(0), F.lit(4), F.lit(6), F.lit(8))), 9) == 0
    assert one(X.wilson(F.lit(0), F.lit(0))) is None and one(X.wilson(F.lit(0), F.lit(5)))["low"] == 0.0
    assert one(X.bin_index(F.lit(2.0), [0.0, 1.0, 2.0])) == 1 and one(X.bin_index(F.lit(1.0), [0.0, 1.0, 2.0])) == 1 and one(X.bin_index(F.lit(2.1), [0.0, 1.0, 2.0])) is None
    s = one(X.sample_interval(F.lit(1e-4), F.lit(1e-5), F.lit(1000), 2e6))
    assert (round(s["start"], 6), round(s["end"], 6)) == (150.0, 250.0)
    assert one(X.to_bool(F.lit("YES"))) is True and one(X.to_count(F.lit("-1"))) is None
    assert abs(one(X.wrap_phase(F.lit(7.0))) - (7.0 - 2 * 3.141592653589793)) < 1e-12
