import numpy as np
import pytest

from traceqc.functions import stats
from traceqc.operators import cohort as C
from traceqc.operators import qc, spectral
from traceqc.operators import traces as G

SEG = "rec string, page_no int, seq int, x0 double, y0 double, x1 double, y1 double"
WORD = "rec string, page_no int, seq int, text string, x0 double, top double, bottom double"
N = 300


def drawn(y, drop=()):
    """Segments of curves (rows, samples) in draw order."""
    out = []
    for j in range(y.shape[1] - 1):
        for i in range(y.shape[0]):
            if (i, j) not in drop:
                out.append(("r", 1, len(out), round(50 + j * 0.85, 2), float(y[i, j]), round(50 + (j + 1) * 0.85, 2), float(y[i, j + 1])))
    return out


def rebuilt(spark, y, drop=()):
    words = [("r", 1, k, name, 20.0, 95.0 + 60 * k, 105.0 + 60 * k) for k, name in enumerate(["O1-A1", "标记"])]
    s = G.signals(spark.createDataFrame(drawn(y, drop), SEG), spark.createDataFrame(words, WORD)).orderBy("ch_idx").collect()
    return np.array([r.samples for r in s]), [r.ch for r in s]


@pytest.fixture
def curves():
    rng = np.random.default_rng(1)
    return np.round(np.array([[100.0], [160.0]]) + rng.normal(0, 5, (2, N)), 2)


def test_rebuilding_returns_what_was_drawn(spark, curves):
    got, names = rebuilt(spark, curves)
    assert names == ["O1-A1", "标记"] and np.array_equal(got, curves)


def test_a_gap_is_filled_linearly_in_an_ambiguous_column(spark, curves):
    got, _ = rebuilt(spark, curves, {(0, 9), (0, 10), (0, 11)})
    # the start of column 9 is the end of column 8; samples 10 and 11 are unknown, 12 is known again
    assert np.allclose(got[0, [10, 11]], curves[0, 9] + (curves[0, 12] - curves[0, 9]) * np.array([1, 2]) / 3)
    keep = np.ones(N, bool)
    keep[[10, 11]] = False
    assert np.array_equal(got[0, keep], curves[0, keep]) and np.array_equal(got[1], curves[1])


def test_too_few_segments_or_no_labels_make_no_page(spark, curves):
    seg = spark.createDataFrame(drawn(curves[:, :100]), SEG)
    words = spark.createDataFrame([("r", 1, 0, "O1-A1", 20.0, 95.0, 105.0), ("r", 1, 1, "O2-A2", 150.0, 95.0, 105.0)], WORD)
    assert G.page_rows(seg, words).count() == 0
    assert G.labels(words).count() == 1


def test_white_noise_keeps_its_variance_and_a_sine_its_power():
    rng = np.random.default_rng(0)
    f, p = spectral.welch(rng.normal(0, 2, (50, 800)), 100, 200, 100)
    assert abs(np.trapezoid(p, f, axis=-1).mean() - 4) < 0.25
    t = np.arange(800) / 100
    m = spectral.metrics(3 * np.sin(2 * np.pi * 10 * t)[None, :])
    assert abs(m["abs_alpha"][0] - 4.5) < 0.02 and m["rel_alpha"][0] > 0.999 and m["hf_40_49"][0] < 1e-6


def test_taper():
    w = spectral.tukey(200)
    assert w[0] == 0 and np.all(w[25:176] == 1) and np.allclose(w[1:], w[:0:-1])


def channel(samples, **more):
    return {"rec": "r", "page_no": 1, "ch_idx": 0, "ch": "O1-A1", "center": 100.0, "row_spacing_pt": 20.0, "uV_per_pt": 2.0, "samples": samples} | more


def test_flat_clipped_and_marker_rows(spark):
    rows = [channel([100.0] * 20), channel([1.0, 2.0, 9.0, 9.0, 9.0, 9.0, 3.0, 1.0, 1.0, 2.0], ch="O2-A2"), channel([0.0] * 48 + [1.0] * 50 + [0.0] * 50 + [1.0] * 10, ch="标记")]
    df = spark.createDataFrame(rows)
    got = {r.ch: r for r in qc.channel_metrics(df).collect()}
    assert set(got) == {"O1-A1", "O2-A2"}
    assert got["O1-A1"].flat_frac == 1 and got["O1-A1"].std_uV == 0 and got["O1-A1"].clip_frac == 1 and got["O1-A1"].zcr_hz == 0
    assert abs(got["O2-A2"].clip_frac - 0.4) < 1e-12 and got["O2-A2"].ptp_uV == 16 and not got["O2-A2"].overrange
    marker = qc.marker_metrics(df).first()
    assert (marker.marker_transitions, marker.marker_regular, marker.marker_positions, marker.marker_levels) == (3, True, "47 97 147", 2)


def test_spectra_of_null_and_short_signals(spark):
    df = spark.createDataFrame([("a", None), ("b", [1.0] * 5), ("c", [float(k % 7) for k in range(800)]), ("d", [None] + [1.0] * 799)], "k string, uv array<double>")
    got = {r.k: r.rel_alpha for r in spectral.with_spectral(df, ["k"]).collect()}
    assert got["a"] is None and got["b"] is None and got["d"] is None and 0 <= got["c"] <= 1


def test_missing_sensitivity_counts_as_the_default(spark):
    df = spark.createDataFrame([("50uV/3.5mm",), ("",), (None,)], "sensitivity string").selectExpr("sensitivity", "800 n_points", "0.1D min_ystep", "0.85D med_xstep")
    got = {r.sensitivity: (r.sens_missing, round(r.uV_per_pt, 4)) for r in qc.with_calibration(df).collect()}
    assert got == {"50uV/3.5mm": (False, 5.0397), "": (True, 3.5278), None: (True, 3.5278)}


def test_average_ranks_and_outliers(spark):
    rows = [("a", v) for v in (3.0, 1.0, 3.0, 2.0, None)] + [("b", 7.0)]
    got = {(r.g, r.v): r.rank for r in stats.average_rank(spark.createDataFrame(rows, "g string, v double"), "g", "v", "rank").collect()}
    assert got == {("a", 1.0): 1, ("a", 2.0): 2, ("a", 3.0): 3.5, ("a", None): None, ("b", 7.0): 1}
    values = [10.0, 11.0, 9.0, 10.5, 9.5, 100.0, float("nan"), None]
    z = stats.robust_z(spark.createDataFrame([("x", v) for v in values], "ch string, v double"), "v").where("abs(z) > 4").collect()
    assert [r.v for r in z] == [100.0]


def test_quantiles_by_rank_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in np.round(rng.normal(size=137 if g == "a" else 40), 1)] + [("c", 7.0), ("d", None)]
    got = {r.g: r for r in stats.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", (0.0, 0.05, 0.5, 0.99, 1.0), ["a", "b", "c", "d", "e"]).collect()}
    assert set(got) == {"a", "b", None, "c"}
    for g, r in got.items():
        own = [v for k, v in rows if k == g]
        assert r.n == len(own) and np.allclose([r.a, r.b, r.c, r.d, r.e], np.quantile(own, [0, 0.05, 0.5, 0.99, 1]), atol=1e-12)
    assert stats.quantiles(spark.createDataFrame([(1.0,), (2.0,)], "v double"), [], "v", (0.5,), ["m"]).first().m == 1.5


def test_summaries_of_start_and_marker(spark):
    t = spark.createDataFrame([("a", 1, 1.0, 2.0, False), ("b", 1, 3.0, 4.0, True)], "rec string, page_no int, rms double, slope double, bad boolean")
    p = spark.createDataFrame([("a", 1, 3), ("a", 2, 3), ("b", 1, 5), ("c", 1, None)], "rec string, page_no int, marker_transitions int")
    got = {r.metric: r for r in C.transient_summary(t, p).collect()}
    assert (got["rms"].p50, got["slope"].max, got["rms"].share, got["rms"].bad) == (2.0, 4.0, 0.5, 1)
    assert [(r.value, r.n) for r in C.marker_transitions(p, 2).collect()] == [(3, 2), (5, 1)]


def test_the_rate_without_a_number_of_points(spark):
    df = spark.createDataFrame([(800,), (None,)], "n_points int").selectExpr("n_points", "'' sensitivity", "0.1D min_ystep", "0.85D med_xstep")
    assert {r.n_points: r.fs for r in qc.with_calibration(df).collect()} == {800: 100.0, None: 100.0}


def test_pages_that_overlap(spark):
    rows = [("a", 1, "3秒", "m"), ("a", 2, "10秒", "m"), ("b", 1, "3", "m"), ("b", 2, "11", "m"), ("c", 1, "3", "m"), ("d", 1, "5", "m"), ("d", 2, "5", "n"), ("e", 1, "", "m"), ("e", 2, None, "m")]
    p = spark.createDataFrame(rows, "rec string, page_no int, time_in_record string, montage string")
    assert [r.rec for r in C.overlapping(p).collect()] == ["a"]
    assert [r.rec for r in C.repeated_starts(p).collect()] == ["d"]


def test_montage_of_odd_pages(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(["O1-A1"],), (["O1-REF"],), (["F3-C3", "O1-A1"],), ([],), (None,)], "c array<string>")
    assert [r.m for r in df.select(C.montage(F.col("c")).alias("m")).collect()] == [C.REFERENCE, C.REF, C.BIPOLAR, C.BIPOLAR, C.BIPOLAR]
