"""Examination dates: parsing, reconciling, day gaps, and merging them into other tables.

Dates are parsed by an explicit list of formats, not by the first value seen. What is missing stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceqc.functions.checks import unique_keys

FORMATS = ("y-M-d H:m:s", "y-M-d", "y/M/d", "y.M.d", "yyyyMMdd")
FROM_REPORT, ORIGINAL, MISSING = "report", "original", "missing"
NEW = ["eeg_date", "eeg_date_source", "eeg_date_changed", "gap_days"]


def lenient(c: Column, formats: tuple = FORMATS) -> Column:
    """The timestamp of a text in any of the formats, else null."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def with_inferred(df: DataFrame, column: str, name: str, formats: tuple = FORMATS, order: Column | None = None) -> DataFrame:
    """Adds ``name``: the timestamp of ``column`` in the one format of the whole column, null for texts in others.

    With ``order``, the first value that is not null decides, by the first format it has; a first value in no format leaves
    all null. Without, the format that most values have, the first of equals. One aggregate gives one row, which is broadcast.
    """
    parsed = [F.try_to_timestamp(F.col(column), F.lit(f)) for f in formats]
    if order is None:
        votes = [F.struct(F.count(p).alias("n"), F.lit(-k).alias("k")) for k, p in enumerate(parsed)]
        best = df.agg(F.greatest(*votes).alias("_v")).select(F.when(F.col("_v.n") > 0, -F.col("_v.k")).alias("_format"))
    else:
        has = F.coalesce(*(F.when(p.isNotNull(), F.lit(k)) for k, p in enumerate(parsed)))
        best = df.where(F.col(column).isNotNull()).agg(F.min_by(F.struct(has.alias("k")), order)["k"].alias("_format"))
    chosen = F.coalesce(*(F.when(F.col("_format") == k, p) for k, p in enumerate(parsed)))
    return df.crossJoin(F.broadcast(best)).withColumn(name, chosen).drop("_format")


def strict(c: Column, formats: tuple = FORMATS) -> Column:
    """As ``lenient``, but a text in none of the formats is an error."""
    failed = F.raise_error(F.concat(F.lit("no date: "), c)).cast("timestamp")
    return F.when(c.isNull(), F.lit(None).cast("timestamp")).otherwise(F.coalesce(lenient(c, formats), failed))


def first_reports(reports: DataFrame) -> DataFrame:
    """The first report of each subject in file order; reports without subject are left out."""
    row = F.struct("source_file", "record_id", "exam_date")
    return reports.where("subject_id is not null").groupBy("subject_id").agg(F.min(row).alias("_r")).select("subject_id", "_r.record_id", "_r.exam_date")


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, rounded down (also below zero)."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(later) - micros(earlier)) / F.lit(86400e6)).cast("int")


def reconciled(subjects: DataFrame, reports: DataFrame) -> DataFrame:
    """Subjects with the date of their first report, or their own; where it comes from; gap in days; changed or not.

    A date counts as changed if the report has one and the subject has none or another.
    """
    df = subjects.join(first_reports(reports), "subject_id", "left").withColumn("_own", lenient(F.col("eeg_time"))).withColumn("_report", lenient(F.col("exam_date")))
    new = F.coalesce("_report", "_own")
    source = F.when(F.col("_report").isNotNull(), FROM_REPORT).when(F.col("_own").isNotNull(), ORIGINAL).otherwise(MISSING)
    changed = (F.col("_report").isNotNull() & ~F.col("_report").eqNullSafe(F.col("_own"))).cast("int")
    return df.select(
        "subject_id",
        "record_id",
        F.to_date("test_time").alias("test_date"),
        F.col("eeg_time").alias("eeg_date_original"),
        F.to_date(new).alias("eeg_date"),
        source.alias("eeg_date_source"),
        floor_days(F.col("test_time"), new).alias("gap_days"),
        changed.alias("eeg_date_changed"),
        F.col("_own").isNull().alias("_no_own"),
    )


def gap_summary(df: DataFrame) -> DataFrame:
    """One row over all gaps; quantiles are interpolated and rounded."""
    gap = F.col("gap_days")
    quantiles = F.percentile(gap, [0.05, 0.25, 0.5, 0.75, 0.95])
    return df.agg(
        F.count(gap).alias("n"),
        F.avg(gap).alias("mean"),
        F.median(gap).alias("median"),
        F.stddev_samp(gap).alias("sd"),
        F.min(gap).alias("min"),
        F.max(gap).alias("max"),
        *(F.round(quantiles[k], 0).alias(f"q{q}") for k, q in enumerate(("05", "25", "50", "75", "95"))),
        F.count_if(gap < 0).alias("negative"),
        F.count_if(gap == 0).alias("zero"),
        F.count_if(gap > 30).alias("over_30"),
        F.count_if(gap > 90).alias("over_90"),
        F.count_if(gap.isNull()).alias("no_gap"),
        F.count_if(F.col("eeg_date_changed") == 1).alias("changed"),
        F.count_if((F.col("eeg_date_source") == FROM_REPORT) & F.col("_no_own")).alias("changed_without_original"),
    )


def by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("eeg_date_source").agg(F.count("*").alias("n"))


def exceptions(df: DataFrame) -> DataFrame:
    """Rows to look at: no gap, a negative one, more than 30 days, or a changed date; with the reason."""
    odd = (F.col("gap_days") < 0) | (F.col("gap_days") > 30) | F.col("gap_days").isNull()
    return df.select("subject_id", "gap_days", odd.alias("odd_gap"), (F.col("eeg_date_changed") == 1).alias("changed")).where("odd_gap or changed")


def merged(table: DataFrame, gaps: DataFrame, key: str = "subject_id") -> DataFrame:
    """``table`` with the date columns of its subjects, replacing earlier ones; a subject that stands twice in ``gaps`` is
    an error, and null keys are equal."""
    own = table.drop(*NEW)
    right = unique_keys(gaps.select(key, *NEW), key).withColumnRenamed(key, "_key")
    return own.join(right, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def merge_summary(df: DataFrame) -> DataFrame:
    gap = F.col("gap_days")
    return df.agg(F.count("*").alias("total"), F.count(gap).alias("with_gap"), F.count_if(gap.isNull()).alias("without_gap"), F.median(gap).alias("median"), F.min(gap).alias("min"), F.max(gap).alias("max"))
