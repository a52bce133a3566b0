import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import dsp
from sigloom.operators import detectors as D
from sigloom.sources import readers, sinks
from sigloom.streaming import jobs

FS = 2e6


def trace(*centers, n=16384, noise=0.002, seed=42):
    t = np.arange(n)
    x = np.random.default_rng(seed).normal(0, noise, n)
    for c in centers:
        x += np.exp(-0.5 * ((t - c) / 420) ** 2) * np.sin(2 * np.pi * 22e3 * t / FS)
    return x


def test_butterworth_edges_are_half_power():
    sos = dsp.butter_bandpass(7e3, 80e3, 4, FS)
    r = np.abs(dsp.frequency_response(sos, np.array([7e3, 80e3, 23.7e3]), FS))
    assert np.allclose(r, [2**-0.5, 2**-0.5, 1], atol=1e-6)


def test_zero_phase_keeps_a_tone_and_stops_a_constant():
    sos = dsp.butter_bandpass(7e3, 80e3, 4, FS)
    x = np.sin(2 * np.pi * 22e3 * np.arange(16384) / FS)
    assert np.abs(dsp.zero_phase(sos, x)[3000:-3000] - x[3000:-3000]).max() < 1e-6
    assert np.abs(dsp.zero_phase(sos, np.full(4000, 3.0))).max() < 1e-9
    assert len(dsp.zero_phase(sos, x[:10])) == 10


def test_spectra_keep_energy():
    x = trace(4000, n=4096)
    f, p = dsp.welch(x, FS, 512)
    assert abs(f[p.argmax()] - 22e3) < 2e6 / 512
    env = dsp.envelope(np.cos(2 * np.pi * 64 * np.arange(1024) / 1024))
    assert np.allclose(env, 1)


def test_peaks():
    x = np.array([0, 1, 0, 2, 2, 2, 0, 3, 0, 1.0])
    assert dsp.find_peaks(x).tolist() == [1, 4, 7]
    assert dsp.find_peaks(x, height=2).tolist() == [4, 7]
    assert dsp.find_peaks(x, distance=4).tolist() == [1, 7]
    assert dsp.prominences(x, np.array([1, 4, 7])).tolist() == [1, 2, 3]
    assert dsp.find_peaks(np.empty(0)).tolist() == []


def test_two_events_and_affine_invariance(spark):
    x = trace(4000, 11500)
    df = spark.createDataFrame([(1, x.tolist()), (2, (7.5 * x + 12).tolist()), (3, None), (4, []), (5, [float("nan")] * 600)], "id int, x array<double>")
    out = [r for r in D.detect_events(df, "id", "x").collect() if r.quality == "strict"]
    by = {i: sorted((r.start, r.end, r.center) for r in out if r.id == i) for i in (1, 2)}
    assert by[1] == by[2] and len(by[1]) == 2 and len(out) == 4
    assert all(abs(c - want) <= 500 for (_, _, c), want in zip(by[1], (4000, 11500)))


def test_sliding_spectra_finds_both(spark):
    df = spark.createDataFrame([(1, trace(4000, 11500).tolist())], "id int, x array<double>")
    out = D.sliding_spectra(df, "id", "x").collect()
    assert len(out) == 2 and all(abs(r.frequency - 22e3) < 500 for r in out)
    assert [round(r.t0 * FS / 500) for r in out] == [8, 23]


def test_saturated_plateau(spark):
    n = np.arange(2048)
    x = np.where((n >= 256) & (n < 1700), 2.5, np.sin(n / 7.0))
    df = spark.createDataFrame([(1, x.tolist())], "id int, x array<double>")
    assert D.saturation(df, "id", "x", least=500, level=5e-3).count() == 1


def test_reading_array_files(spark, tmp_path):
    d = tmp_path / "yeast"
    d.mkdir()
    np.save(d / "a_1.npy", np.arange(6, dtype=np.float32))
    np.save(d / "b_2.npy", np.array([[1.0, np.nan, 3.0]]))
    (d / "c_3.npy").write_bytes(b"broken")
    np.save(d / "d_4.npy", np.ones((2, 2)))
    t = readers.traces(spark, str(tmp_path))
    rows = {r.stem: r for r in t.collect()}
    assert rows["a_1"].signal == [0, 1, 2, 3, 4, 5] and rows["a_1"]["class"] == "yeast" and rows["a_1"].dtype == "float32"
    assert rows["b_2"].n == 3 and rows["b_2"].finite_fraction == pytest.approx(2 / 3) and rows["b_2"].mean == 2
    assert rows["c_3"].load_error and rows["d_4"].load_error and rows["d_4"].signal is None
    whole = {(r.path[-7:], len(r.signal)) for r in readers.noise_chunks(t, 4, True).collect()}
    assert whole == {("a_1.npy", 4), ("b_2.npy", 3)}
    assert readers.noise_chunks(t, 4, False).count() == 1


def test_npy_versions():
    buffer = io.BytesIO()
    np.lib.format.write_array(buffer, np.arange(3), version=(2, 0))
    assert readers.parse_npy(buffer.getvalue()).tolist() == [0, 1, 2]


def test_labels_round_trip(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1 0.5 0.25\n\n0 0.1 0.1 9\n7 0.5 0.1\n0 0.99 0.5\n0 a b\n")
    (tmp_path / "empty.txt").write_text("")
    out = readers.labels(spark, str(tmp_path), ["c2", "c4"], 1000).collect()
    assert sorted(str(r.problem) for r in out) == ["None", "fields", "not numbers", "out of range", "unknown class"]
    good = [r for r in out if r.problem is None][0]
    assert (good.stem, good["class"], good.start, good.end) == ("x", "c4", 375, 625)
    df = spark.createDataFrame([("x", 1, 375, 625), ("y", None, None, None)], "stem string, class_id int, start int, end int")
    text = {r.stem: r.text for r in sinks.label_files(df, ["stem"], 1000).collect()}
    assert text == {"x": "1 0.5000000000 0.2500000000", "y": ""}


def test_publish_is_all_or_nothing(spark, tmp_path):
    df = spark.range(5)
    path = str(tmp_path / "out")
    with pytest.raises(ValueError, match="audit failed: none over 3"):
        sinks.publish(df, path, [("none over 3", lambda d: d.where("id > 3"))])
    assert not list(tmp_path.iterdir())
    sinks.publish(df, path, [("none over 9", lambda d: d.where("id > 9"))])
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(FileExistsError):
        sinks.publish(df, path)


def test_must_match(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    assert readers.must_match(a, a, ["k"]).count() == 2
    with pytest.raises(Exception, match="no match for y"):
        readers.must_match(a, a.where("k = 'x'"), ["k"]).collect()


def test_streams_agree_with_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.hopping(stream, "12 hours", "6 hours", "60 days").writeStream.outputMode("complete").format("memory").queryName("hops").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.window.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("hops")) == key(jobs.hopping(events, "12 hours", "6 hours", "60 days"))
    log = spark.createDataFrame([("a", 1, "no"), ("a", 3, "yes"), ("b", 2, "no"), ("a", 2, "no")], "id string, revision int, said string")
    assert {r.id: r.said for r in jobs.latest_decisions(log, "id", "revision").collect()} == {"a": "yes", "b": "no"}


def test_filter_is_the_recursion():
    """Sections that step together give the bits of one section after the other."""
    sos = dsp.butter_bandpass(7e3, 80e3, 4, FS)
    for shape in ((1,), (3,), (2, 5), (2, 3, 40)):
        x = np.random.default_rng(1).normal(size=shape)
        y = x
        for b0, b1, b2, _, a1, a2 in sos:
            z1 = z2 = np.zeros(shape[:-1])
            out = np.empty(shape)
            for i in range(shape[-1]):
                out[..., i] = b0 * y[..., i] + z1
                z1 = b1 * y[..., i] - a1 * out[..., i] + z2
                z2 = b2 * y[..., i] - a2 * out[..., i]
            y = out
        assert np.array_equal(dsp.sos_filter(sos, x), y)


def test_traces_are_made_in_many_tasks(spark, tmp_path):
    """One file of suppliers does not put all traces into one task, and a task's share does not grow with the table."""
    from sigloom.plans.queries import TRACES, supplier_traces

    spark.range(4 * TRACES * 4).selectExpr("id as s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    sizes = supplier_traces(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 16 and max(r["count"] for r in sizes) < 2 * TRACES


def test_sampled_traces_are_those_of_one_expression(spark, tmp_path):
    """Samples worked out as compiled rows are the bits of the lambda over an array; other columns stay with their trace."""
    from sigloom.plans.queries import supplier_arrays, supplier_traces

    spark.range(70).selectExpr("IF(id = 5, NULL, id * 911) as s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = lambda df: sorted(((r.s_suppkey is not None, r.s_suppkey), r.signal) for r in df.collect())
    made = supplier_traces(spark, str(tmp_path))
    assert [x for x in rows(made.where("s_suppkey is not null"))] == [x for x in rows(supplier_arrays(spark, str(tmp_path)).where("s_suppkey is not null"))]
    assert [r.signal for r in made.where("s_suppkey is null").collect()] == [[None] * 4096]
    assert "transform(" not in made._jdf.queryExecution().executedPlan().toString()  # no lambda is interpreted
    df = spark.createDataFrame([(1, [2, 3]), (1, [2, 3]), (2, None), (None, [])], "k int, spans array<int>")
    for n in (1, 7, 11, 24):
        got = D.sampled_traces(df.coalesce(1), "x", n, lambda i: i * F.coalesce("k", F.lit(5))).collect()
        assert [(r.k, r.spans) for r in got] == [(1, [2, 3]), (1, [2, 3]), (2, None), (None, [])]
        assert [r.x for r in got] == [[float(i * k) for i in range(n)] for k in (1, 1, 2, 5)]
    assert D.sampled_traces(df.where("k > 9"), "x", 7, lambda i: i).collect() == []


@pytest.mark.parametrize("name", ["event_descriptors", "detected_events", "noise_summary", "saturation_scan", "sliding_spectra", "band_energy"])
def test_traces_cross_to_python_once(spark, small, name):
    """The call that uses the traces packs them too, and gives the rows that it gives over the table of traces."""
    from sigloom.plans import queries, registry

    made = registry.QUERIES[name](spark, small)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    with pytest.MonkeyPatch.context() as m:
        m.setattr(queries, "supplier_samples", queries.supplier_traces)
        over_table = registry.QUERIES[name](spark, small)
    assert over_table._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    rows = sorted(map(tuple, made.collect()))
    assert rows and rows == sorted(map(tuple, over_table.collect()))


def test_operators_pass_over_traces_without_samples(spark):
    """Traces whose samples are null, and tables without rows, give no rows."""
    rows = spark.createDataFrame([(1, 2.0), (2, None), (None, 3.0)], "k int, y double")
    at = lambda i: F.sin(i * 0.7) * F.col("y")
    assert sorted((r.k is not None, r.k, r.band) for r in D.band_energy(D.Sampled(rows, "x", 64, at), "k", "x", 2e6, [("all", 0.0, 1e6)]).collect()) == [(False, None, "all"), (True, 1, "all")]
    assert D.band_energy(D.Sampled(rows.where("k > 9"), "x", 64, at), "k", "x", 2e6, [("all", 0.0, 1e6)]).collect() == []


def test_sliding_windows_are_those_of_one_at_a_time(monkeypatch):
    """The windows of a trace are transformed together, with a taper made once; levels are the bits of single windows."""
    made = []
    hamming = dsp.hamming
    monkeypatch.setattr(dsp, "hamming", lambda n: made.append(n) or hamming(n))
    c = D.Detection()
    x = np.stack([trace(4000, 11500), trace(9000, seed=7)])
    got = D._sliding(c, 1024, 256, 3, 1000.0, 0.5e-3)(x, None)
    assert made == [1024] and all(got)
    f = np.fft.rfftfreq(1024, 1 / c.fs)
    for y, found in zip(D.filtered(x, c), got):
        energies = [float((np.abs(np.fft.rfft(y[i * 256 : i * 256 + 1024] * hamming(1024)))[f <= c.high] ** 2).sum()) for i in range(len(y) // 256 - 3)]
        assert all(r["energy"] == energies[r["window"]] and r["noise_floor"] == float(np.mean(np.sort(energies)[:3])) for r in found)
    assert D._sliding(c, 1024, 256, 3, 1000.0, 0.5e-3)(x[:, :100], None) == [[], []]
