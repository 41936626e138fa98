"""A fresh place in the folder that the driver and the executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from traceqc.functions.lineage import own_dir


def scratch(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
