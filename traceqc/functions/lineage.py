"""What is written between steps, in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is that of ``spark.checkpoint.dir``. Only a local master, where all run on one machine, may go without one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def own_dir(spark: SparkSession) -> str:
    """What this application writes between steps lies here."""
    return f"{shared_dir(spark)}/traceqc-{spark.sparkContext.applicationId}"


def released(spark: SparkSession) -> None:
    """Deletes what this application wrote between steps; results that were not read to their end are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read again.

    All later uses read the same rows, a lost executor costs no recomputation, and the planner knows the table's real
    size; a checkpoint would keep the estimate of the plan behind it, which grows with each join of a loop.
    """
    path = f"{own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` as a table of ``n`` buckets by ``key`` in the shared folder, each bucket one sorted file, read again.

    Joins of two such tables (with equal ``n``) and aggregates by ``key`` need no exchange. Rows are dealt out once, here,
    unless ``df`` comes from such a table already. The catalog keeps no name for it.
    """
    spark, name = df.sparkSession, f"traceqc_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).sortBy(key).option("path", f"{own_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # the files stay
    return out


def forgotten(df: DataFrame) -> None:
    """Deletes the files behind a table that ``cut`` or ``bucketed`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if folder.rsplit("/", 1)[0].endswith(own_dir(spark).rsplit("/", 1)[1]):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
