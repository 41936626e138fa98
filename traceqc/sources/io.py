"""Reading and writing the tables between steps. Parquet is the default between steps; CSV and JSON are for exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WAVEFORM_SCHEMA = (
    "record_id string, name string, source_file string, examiner string, start string, start_time string, length string, "
    "waveforms array<struct<page:int, channels:array<string>, marker_row:boolean, time_in_record:string, clock_time:string, stage:string, sensitivity:string, speed:string>>"
)


def pages(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row for each page of a document: text split at form feeds, without one empty piece at the end."""
    pieces = F.split(text, "\f", -1)
    kept = F.when(F.col(text).endswith("\f"), F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return documents.select(*(c for c in documents.columns if c != text), F.size(kept).alias("n_pages"), F.posexplode(kept).alias("page_no", "page_text")).withColumn("page_no", F.col("page_no") + 1)


BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, rows: int = 50_000) -> None:
    """CSV with a byte order mark and a header in each file, quotes doubled; texts may hold line ends and outer blanks.

    Texts with line ends can't be split, so a file is read by one task: none has more than ``rows`` rows.
    """
    first, *others = df.columns
    marked = df.select(F.col(first).alias(BOM + first), *others)
    writer = marked.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("maxRecordsPerFile", rows).mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with all columns as strings; a byte order mark is skipped, empty fields are null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


SUBJECT_COLUMNS, MANUAL_COLUMNS = ["subject_id", "name", "age", "sex"], ["record_id", "subject_id"]


def read_subjects(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The table of subjects, all columns as strings; CSV, or Parquet where the path ends so."""
    columns = SUBJECT_COLUMNS if columns is None else columns
    if not path.rstrip("/").endswith(".parquet"):
        return read_csv(spark, path, columns)
    return spark.read.parquet(path).select(*(F.col(c).cast("string").alias(c) for c in columns))


def read_manual(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The table of manual matches as strings, None where there is none."""
    if path is None:
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return read_subjects(spark, path, MANUAL_COLUMNS)


def write_waveforms(df: DataFrame, path: str) -> None:
    """One JSON object a line for each record."""
    df.write.mode("overwrite").json(path)


def read_waveforms(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested waveform records; ``multi_line`` for one indented object a file."""
    return spark.read.schema(WAVEFORM_SCHEMA).option("multiLine", multi_line).json(path)


def latest(df: DataFrame, key: str = "record_id", order: str = "source_file") -> DataFrame:
    """One row for each key: that of the last file. The aggregate keeps one row a key before rows are exchanged."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


PART = "_part"


def upsert(batch: DataFrame, path: str, key: str = "record_id", order: str = "source_file", parts: int = 256) -> None:
    """Writes a batch of records into the store at ``path``: of records with one key, the last file of the batch replaces what
    the store has; all other records stay.

    The store is partitioned by a hash of the key, and only partitions that the batch touches are read and rewritten (dynamic
    overwrite replaces these, once all their rows are written). ``parts`` must be the same for every batch.
    """
    spark = batch.sparkSession
    new = latest(batch, key, order).withColumn(PART, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        ids = new.select(F.col(key).alias("_key"), F.col(PART).alias("_in"))
        touched = [r[0] for r in ids.select("_in").distinct().collect()]  # ``parts`` numbers at most
        kept = spark.read.parquet(path).where(F.col(PART).isin(touched)).join(ids, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        new = kept.unionByName(new, allowMissingColumns=True)
    writer = new.repartition(PART).write.option("partitionOverwriteMode", "dynamic").partitionBy(PART)
    writer.mode("overwrite").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a store that ``upsert`` wrote."""
    return spark.read.parquet(path).drop(PART)


def write_signals(df: DataFrame, path: str) -> None:
    """Signals as one row a channel (record, page, channel, samples as floats)."""
    df.withColumn("samples", F.col("samples").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


PAGE = ["rec", "page_no"]


def shard(n: int) -> Column:
    """The shard of a page; it is also the number of its bucket, so that a shard is one file."""
    return F.pmod(F.hash(*PAGE), F.lit(n))


def write_signal_table(df: DataFrame, table: str, path: str, shards: int) -> None:
    """Signals as a table of the catalog with its files at ``path``, in ``shards`` files by page, each sorted by page.

    Joins and aggregates by page need no exchange, and ``signals_of`` reads only the shards of the pages it is given.
    """
    rows = df.withColumns({"samples": F.col("samples").cast("array<float>"), "shard": shard(shards)})
    writer = rows.repartition(shards, *PAGE).write.partitionBy("shard").bucketBy(shards, *PAGE).sortBy(*PAGE)
    writer.option("path", path).mode("overwrite").saveAsTable(table)


def signals_of(signals: DataFrame, pages: DataFrame, shards: int) -> DataFrame:
    """The signals of the given pages. ``signals`` is such a table; where the planner broadcasts ``pages``, only the shards
    that hold one are read."""
    wanted = pages.select(*PAGE).distinct().withColumn("shard", shard(shards))
    return signals.join(wanted, ["shard", *PAGE], "left_semi").drop("shard")
