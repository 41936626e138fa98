"""Calibration and quality metrics of rebuilt pages and channels; built-in functions but for the spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceqc.functions.text import sensitivity
from traceqc.operators.traces import MARKER, PAGE

PT_PER_MM = 72 / 25.4
SECONDS = 8.0
EXTREME, MARKER_STEP = 0.13, 0.3
FALLBACK_HZ = 100.0


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def with_calibration(pages: DataFrame) -> DataFrame:
    """Adds microvolts for a point, resolution and sampling rates; an unreadable sensitivity counts as 50 uV/5 mm, and
    without a number of points the rate ``fs`` is 100 Hz.

    Needs sensitivity, n_points, min_ystep and med_xstep.
    """
    uv, mm = sensitivity(F.col("sensitivity"))
    out = pages.withColumn("sens_missing", uv.isNull() | mm.isNull())
    out = out.withColumn("uV_per_pt", F.when(F.col("sens_missing"), 50.0 / (5.0 * PT_PER_MM)).otherwise(uv / (mm * PT_PER_MM)))
    fs_len = F.col("n_points") / SECONDS
    return out.withColumns({"y_res_uV": F.col("min_ystep") * F.col("uV_per_pt"), "fs_len": fs_len, "fs_paper": 1 / F.col("med_xstep") * 30 * PT_PER_MM, "fs": F.coalesce(fs_len, F.lit(FALLBACK_HZ))})


def row_spacing(labels: DataFrame) -> DataFrame:
    """Number of rows of a page, and the median distance of their centres."""
    step = F.col("center") - F.lag("center").over(Window.partitionBy(*PAGE).orderBy("center"))
    return labels.withColumn("_step", step).groupBy(*PAGE).agg(F.count("*").cast("int").alias("n_rows"), F.median("_step").alias("row_spacing_pt"))


def in_microvolts(channels: DataFrame) -> DataFrame:
    """Adds ``uv``: samples around their mean, upwards positive. Needs samples and uV_per_pt."""
    centred = F.transform(F.array(mean_of(F.col("samples"))), lambda m: F.transform("samples", lambda v: -(v - m) * F.col("uV_per_pt")))[0]
    return channels.withColumn("uv", centred)


def clipped(y: Column, top: Column, bottom: Column) -> Column:
    """Samples in runs of three or more that stay at an extreme."""
    extreme = lambda v: (F.abs(v - top) < EXTREME) | (F.abs(v - bottom) < EXTREME)
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("total"))

    def step(acc, v):
        run = F.when(extreme(v), acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), (acc["total"] + F.when(run == 3, 3).when(run > 3, 1).otherwise(0)).alias("total"))

    return F.aggregate(y, start, step)["total"]


def channel_metrics(channels: DataFrame) -> DataFrame:
    """Amplitude, flatness, clipping and zero crossings of every channel but the marker.

    Needs samples (points), center, row_spacing_pt and uV_per_pt; keeps all columns.
    """
    c = channels.where(F.col("ch") != MARKER).withColumns({"_n": F.size("samples"), "_mean": mean_of(F.col("samples")), "_top": F.array_max("samples"), "_bottom": F.array_min("samples")})
    pairs = lambda f: F.zip_with(F.slice("samples", F.lit(2), F.col("_n") - 1), F.slice("samples", F.lit(1), F.col("_n") - 1), f)
    square = F.aggregate("samples", F.lit(0.0), lambda s, x: s + (x - F.col("_mean")) * (x - F.col("_mean"))) / F.col("_n")
    sign = lambda v: F.signum(F.col("_mean") - v)
    count = lambda a: F.size(F.filter(a, lambda x: x))
    ptp = F.col("_top") - F.col("_bottom")
    return c.withColumns(
        {
            "std_uV": F.sqrt(square) * F.col("uV_per_pt"),
            "ptp_pt": ptp,
            "ptp_uV": ptp * F.col("uV_per_pt"),
            "flat_frac": count(pairs(lambda a, b: a == b)) / (F.col("_n") - 1),
            "n_levels": F.size(F.array_distinct(F.transform("samples", lambda v: F.round(v, 3)))),
            "clip_frac": clipped(F.col("samples"), F.col("_top"), F.col("_bottom")) / F.col("_n"),
            "overrange": ptp > F.col("row_spacing_pt"),
            "off_center_pt": F.col("_mean") - F.col("center"),
            "zcr_hz": count(pairs(lambda a, b: sign(a) != sign(b))) / 2 / SECONDS,
        }
    ).drop("_n", "_mean", "_top", "_bottom")


def marker_metrics(channels: DataFrame) -> DataFrame:
    """Transitions of the marker row of a page: how many, where, whether regular, and its distinct levels."""
    m = channels.where(F.col("ch") == MARKER)
    n = F.size("samples")
    jumps = F.filter(F.sequence(F.lit(0), n - 2), lambda i: F.abs(F.get("samples", i + 1) - F.get("samples", i)) > MARKER_STEP)
    m = m.withColumn("_at", F.when(n > 1, jumps).otherwise(F.array().cast("array<int>")))
    gaps = F.zip_with(F.slice("_at", F.lit(2), F.size("_at") - 1), F.slice("_at", F.lit(1), F.size("_at") - 1), lambda b, a: b - a)
    regular = F.when(F.size("_at") >= 2, (F.array_min(gaps) >= 45) & (F.array_max(gaps) <= 55)).otherwise(F.lit(False))
    return m.select(
        *PAGE,
        F.size("_at").alias("marker_transitions"),
        F.coalesce(regular, F.lit(False)).alias("marker_regular"),
        F.array_join(F.transform("_at", lambda x: x.cast("string")), " ").alias("marker_positions"),
        F.size(F.array_distinct(F.transform("samples", lambda v: F.round(v, 1)))).alias("marker_levels"),
    )
