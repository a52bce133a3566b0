import math

from pyspark.sql import functions as F

from sigloom.operators import composition as C


def test_permutations_and_concatenation(spark):
    g = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "g int, k string")
    out = C.permutations(g, ["g"], "k", 3).collect()
    assert len(out) == 6 and len({tuple(r.order) for r in out}) == 6 and {r.g for r in out} == {1}
    s = spark.createDataFrame([(1, 1, [3.0, 4.0], [(0, 1)]), (1, 0, [1.0, 2.0], [(1, 2)])], "g int, p int, x array<double>, e array<struct<start:int,end:int>>")
    r = C.concatenated(s, ["g"], "p", "x", "e", 2).first()
    assert r.signal == [1, 2, 3, 4] and [tuple(e) for e in r.events] == [(1, 2), (2, 3)]


def test_expressions_on_arrays(spark):
    df = spark.createDataFrame([([0.0] * 4 + [9.0] * 4, [1.0, -1.0] * 4)], "x array<double>, n array<double>")
    one = lambda c: df.select(c.alias("v")).first().v
    assert one(C.smoothed_joins(F.col("x"), 4, 2, 2)) == [0, 0, 0, 3, 6, 9, 9, 9]
    noisy = one(C.with_noise(F.lit([3.0] * 8), F.col("n"), F.lit(20.0)))
    assert math.isclose(noisy[0], 3.3) and math.isclose(noisy[1], 2.7)
    assert one(C.with_noise(F.col("n"), F.lit([0.0] * 8), F.lit(1.0))) is None
    assert one(C.guarded_edges(F.col("x"), F.col("n"), 1)) == [1, 0, 0, 0, 9, 9, 9, -1]
    assert math.isclose(one(C.snr_db(F.lit([1.0, 1.0, 10.0, 10.0]), F.lit(2), F.lit(4))), 20.0)
    e = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")))
    assert one(C.particle_mask(4, e)) == [False, True, True, False] and one(C.edge_safe(e, F.lit(8), 2)) == []
