"""Exact selection by refinement, distributions and histograms against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceqc.functions import stats
from traceqc.operators import cohort as C


def scans(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("FileScan")


ODD = [0.0, -0.0, 5e-324, -5e-324, 1e-310, 2.0**-1022, 1.0, np.nextafter(1, 0), np.nextafter(1, 2), 2.0**52, np.nextafter(2.0**52, 0), 1.7e308, -1.7e308, math.inf, -math.inf, 3.0, -3.0]


def test_bins_keep_the_order_of_doubles(spark):
    rng = random.Random(2)
    values = [*ODD, *(s * m * 2.0**e for e in range(-1070, 1023, 9) for s in (1, -1) for m in (1.0, 1 + 2**-16, 1.999999, np.nextafter(2, 0)))]
    values += [rng.gauss(0, 1) for _ in range(500)] + [1.7e9 + rng.random() for _ in range(200)]
    got = spark.createDataFrame([(float(v),) for v in values], "_v double").withColumn("b", stats.placed("_v")).orderBy("_v").collect()
    bins = [r.b for r in got]
    assert bins == sorted(bins) and len(set(bins)) > 900


@pytest.mark.parametrize("kind", ["wide", "narrow", "few", "odd"])
def test_quantiles_of_any_spread(spark, kind):
    rng = np.random.default_rng(1)
    values = {"wide": np.exp(rng.normal(0, 40, 801)) * rng.choice([-1, 1], 801), "narrow": 1.7e9 + rng.random(500), "few": rng.integers(-2, 3, 400) / 4, "odd": np.array([v for v in ODD if math.isfinite(v)])}[kind]
    probs = (0.0, 0.01, 0.25, 0.5, 0.77, 1.0)
    names = list("abcdef")
    rows = spark.createDataFrame([(float(v),) for v in values] + [(math.nan,), (None,)], "v double").repartition(3)
    r = stats.quantiles(rows, [], "v", probs, names).first()
    s = np.sort(values)
    for p, name in zip(probs, names):
        x = (len(s) - 1) * p
        lo, hi = s[math.floor(x)], s[math.ceil(x)]
        want = lo if math.floor(x) == math.ceil(x) else (math.ceil(x) - x) * lo + (x - math.floor(x)) * hi
        assert r[name] == pytest.approx(want, rel=1e-12, abs=0)
    assert r.n == len(values)


def test_ranks_over_many_bins(spark):
    rng = np.random.default_rng(5)
    values = np.round(np.concatenate([rng.normal(0, 1, 300), rng.normal(1000, 1, 300), [-0.5] * 7]), 2)
    got = {(r.g, r.v): r.rank for r in stats.ranks(spark.createDataFrame([(g, float(v)) for v in values for g in "xy"], "g string, v double"), ["g"], "v", "rank").collect()}
    for v in set(values.tolist()):
        want = (values < v).sum() + ((values == v).sum() + 1) / 2
        assert got[("x", v)] == got[("y", v)] == want


def test_robust_deviation_of_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(ch, float(v)) for ch, scale in (("a", 1), ("b", 50)) for v in np.append(np.exp(rng.normal(0, 1, 101)) * scale, 0.0)] + [("a", math.nan), ("b", None), ("c", None)]
    got = stats.robust_z(spark.createDataFrame(rows, "ch string, v double"), "v", log=True).collect()
    assert len(got) == 206
    for ch in "ab":
        own = np.log10(np.maximum([v for c, v in rows if c == ch and v is not None and not math.isnan(v)], 1e-6))
        m = np.median(own)
        s = np.median(abs(own - m))
        z = sorted(r.z for r in got if r.ch == ch and r.z is not None)
        assert np.allclose(z, np.sort((own - m) / (1.4826 * s + 1e-12)), atol=1e-9)


def wave(stage, channels, marker=True, sensitivity="s", speed="v"):
    return {"wave_idx": 0, "channels": channels, "stage": stage, "sensitivity": sensitivity, "speed": speed, "marker_row": marker}


WAVES = "array<struct<wave_idx:int,channels:array<string>,stage:string,sensitivity:string,speed:string,marker_row:boolean>>"
RECORDS = [
    ("a", "x", "8秒", [wave("", ["O1"]), wave("r", ["O1", "O1"], False)]), ("b", "", None, []), ("c", "x", "16", [wave("r", []), wave("r", ["P"], None), wave("q", ["P", "Q"])]),
    ("d", "y", "8", [wave(None, None)]),
]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("records") / "r")
    spark.createDataFrame(RECORDS, f"rec string, examiner string, length string, waveforms {WAVES}").write.parquet(path)
    return spark.read.parquet(path)


def test_distributions_of_all_keys_in_one_scan(records):
    df = C.distributions(records)
    assert scans(df) == 1
    got = {}
    for r in df.collect():
        got.setdefault(r.key, {})[r.value] = (r.n, round(r.share, 6), r.further)
    assert got["stage"] == {"r": (3, 0.6, 0), "(空)": (1, 0.2, 0), "q": (1, 0.2, 0)}
    assert got["n_channels"] == {"1": (2, 0.4, 0), "2": (2, 0.4, 0), "0": (1, 0.2, 0)}
    assert got["marker_row"] == {"true": (4, 0.8, 0), "false": (1, 0.2, 0)}
    assert got["examiner"] == {"x": (2, 0.5, 0), "(空)": (1, 0.25, 0), "y": (1, 0.25, 0)}
    assert got["length"] == {"8": (2, 0.666667, 0), "16": (1, 0.333333, 0)}
    assert got["n_pages"] == {"2": (1, 0.25, 0), "0": (1, 0.25, 0), "3": (1, 0.25, 0), "1": (1, 0.25, 0)}


def test_further_values_and_ties(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abcdefgh"), rng.choice(["k", "l"])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, v string, k string").repartition(4)
    one = F.array(F.struct(F.col("k").alias("key"), F.col("v").alias("value")))
    got = [(r.key, r.value, r.n, r.further) for r in stats.most_common(stats.counted(df, one, F.col("i")), {"k": 3, "l": 20}).collect()]
    want = []
    for k, top in (("k", 3), ("l", 20)):
        c = Counter(v for _, v, key in rows if key == k)  # first seen first among equals, as the rows come
        want += [(k, v, n, max(len(c) - top, 0)) for v, n in c.most_common(top)]
    assert sorted(got) == sorted(want)


def test_consistency_in_one_scan(records):
    df = C.consistency(records, ["stage", "speed"])
    assert scans(df) == 1
    assert {r.key: (r.consistent, r.records, r.n_values, r.all_agree) for r in df.collect()} == {"stage": (2, 4, 3, False), "speed": (4, 4, 1, True)}


def test_histograms_of_all_metrics_in_two_scans(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = {"a": np.exp(rng.normal(size=200)), "b": rng.normal(size=200), "c": np.full(200, 3.0)}
    values["b"][:5] = 0
    rows = [tuple(float(values[m][i]) for m in "abc") for i in range(200)] + [(None, math.nan, 3.0)]
    spark.createDataFrame(rows, "a double, b double, c double").write.parquet(str(tmp_path / "m"))
    df = stats.histograms(spark.read.parquet(str(tmp_path / "m")), {"a": True, "b": False, "c": False}, 7)
    assert scans(df) == 2
    got = {(r.metric, r.bin): r.n for r in df.collect()}
    for m, v in (("a", np.log10(values["a"])), ("b", values["b"][5:])):
        assert [got.get((m, k), 0) for k in range(7)] == np.histogram(v, 7)[0].tolist()
    assert got[("c", 0)] == 201


def test_matching_and_other_texts(spark):
    rows = [("r1", "滤波 70Hz"), ("r1", "滤波 70Hz"), ("r2", "50 Hz"), ("r2", "abc"), ("r3", None)]
    t = spark.createDataFrame(rows, "rec string, text string")
    assert sorted(tuple(r) for r in C.matching_texts(t).collect()) == [("50 Hz", 1, 1), ("滤波 70Hz", 2, 1)]
    assert sorted(tuple(r) for r in C.other_texts(t).collect()) == [("50 Hz", 1, 1), ("abc", 1, 1)]
    assert tuple(C.text_search(t).first()) == (3, 2, "50 Hz|滤波 70Hz", 2)
    assert tuple(C.text_search(t.limit(0)).first()) == (0, 0, "", 0)
