"""Linking reports to subjects: exact keys, then name and sex with an age band, then manual matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceqc.functions.text import strip
from traceqc.functions.checks import unique_keys

KEYS = ["name", "age", "sex"]
TIER1, MANUAL = "name+age+sex", "manual"


def tier2_label(tolerance: int) -> str:
    return f"name+sex+age<={tolerance}"


def stripped(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys without blanks at both ends; an empty key is missing."""
    return df.withColumns({k: F.nullif(strip(F.col(k)), F.lit("")) for k in keys})


def ambiguous_count(subjects: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """How many subject rows have keys that are not theirs alone."""
    return stripped(subjects).groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("ambiguous"))


def unique_subjects(subjects: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Subjects whose keys no other row has; null keys equal each other."""
    return stripped(subjects).groupBy(*keys).agg(F.count("*").alias("_n"), F.first("subject_id").alias("subject_id")).where("_n = 1").drop("_n")


def exact(reports: DataFrame, unique: DataFrame) -> DataFrame:
    """Tier 1: a left join of equal keys, null keys being equal. Both sides have at most one row for a null key that
    matters: the unique side has one, so reports without a key meet one row."""
    right = unique.select(*(F.col(k).alias(f"_{k}") for k in KEYS), "subject_id")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    return reports.join(right, on, "left").drop(*(f"_{k}" for k in KEYS))


def age_band(open_reports: DataFrame, unique: DataFrame, row: str, tolerance: int = 2) -> DataFrame:
    """Tier 2: (row, hit, subject_id) for reports with exactly one candidate of equal name and sex within the age band.

    Ages are cut into buckets of ``tolerance + 1`` years and a report probes its own and both next to it, so the join
    stays one of equal keys and a frequent name is spread over its ages. An age that is no number matches nothing.
    """
    age = lambda c: F.col(c).try_cast("double")
    width = tolerance + 1
    left = open_reports.where(F.col("name").isNotNull() & F.col("sex").isNotNull()).select(row, "name", "sex", age("age").alias("_age"))
    left = left.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_age") / width) - 1, F.floor(F.col("_age") / width) + 1)))
    right = unique.select("name", "sex", age("age").alias("_of"), "subject_id").withColumn("_bucket", F.floor(F.col("_of") / width))
    pairs = left.join(right, ["name", "sex", "_bucket"]).where(F.abs(F.col("_of") - F.col("_age")) <= tolerance)
    return pairs.groupBy(row).agg(F.count("*").alias("_n"), F.first("subject_id").alias("subject_id")).where("_n = 1").drop("_n")


def linked(reports: DataFrame, subjects: DataFrame, manual: DataFrame | None = None, row: str = "source_file", tolerance: int = 2) -> DataFrame:
    """Reports with ``subject_id`` and ``match_method``; earlier results in these columns are replaced.

    A manual match holds for every row of its record id and wins over both tiers, even where it says null; a record id
    that stands twice in the manual table is an error.
    """
    own = stripped(reports.drop("subject_id", "match_method"))
    unique = unique_subjects(subjects)
    first = exact(own, unique)
    band = age_band(first.where("subject_id is null"), unique, row, tolerance).select(row, F.col("subject_id").alias("_id"), F.lit(True).alias("_hit"))
    method = F.when(F.col("subject_id").isNotNull(), TIER1).when(F.col("_hit"), tier2_label(tolerance)).otherwise("")
    out = first.join(band, row, "left").withColumn("match_method", method).withColumn("subject_id", F.coalesce("subject_id", "_id")).drop("_id", "_hit")
    if manual is None:
        return out
    given = unique_keys(manual, "record_id").select("record_id", F.col("subject_id").alias("_id"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    out = out.join(given, "record_id", "left")
    return out.withColumn("subject_id", F.when(hit, F.col("_id")).otherwise(F.col("subject_id"))).withColumn("match_method", F.when(hit, MANUAL).otherwise(F.col("match_method"))).drop("_id", "_hit")


def coverage(out: DataFrame) -> DataFrame:
    """Rows, matched and unmatched rows."""
    return out.agg(F.count("*").alias("total"), F.count("subject_id").alias("matched"), F.count_if(F.col("subject_id").isNull()).alias("unmatched"))


def unmatched(out: DataFrame) -> DataFrame:
    return out.where("subject_id is null").select(*KEYS, "record_id", "source_file")
