"""Checks that a plan carries with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_keys(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, failing when it runs if two rows have the same keys (null keys are equal).

    The check is an aggregate of the rows themselves, so no second job is needed and nothing is collected.
    """
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(F.lit(1).alias("_"), *rest)).alias("_row"))
    message = F.concat(F.lit("more than one row for "), F.concat_ws(",", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)))
    checked = F.when(F.col("_n") > 1, F.raise_error(message).cast(rows.schema["_row"].dataType)).otherwise(F.col("_row"))
    return rows.withColumn("_row", checked).select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns))
