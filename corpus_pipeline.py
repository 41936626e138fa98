"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

Defined results of odd rows, in any stage: a null or empty text fails the quality rules, so it goes there; further stages
by themselves keep it (a null text stays null), but for the mixture, where a document without tokens is never read. A null
language or source is a value of its own. Rows without an id take part like others and are told apart by their texts; as
near copies they come after all that have one. Decisions are made for an id and text, near copies for an id. Rows that
repeat each other are kept or dropped together; they are copies only where their ids differ. Texts of any length are read
whole. Further columns are kept with their values, whatever their names; ``n_chars`` follows a changed text. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceqc.llm import decontamination, jaccard_join, line_dedup, mixing, quality_rules
from traceqc.llm.common import cut, fresh, own_dir, without


#: What makes two documents near copies.
NEAR = jaccard_join.Join(width=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or their host's verdict reject go."""
    text_hash = fresh(docs, "text_hash")
    rejected = cut(quality_rules.judged(docs).where("not kept").select("doc_id", F.col("text_hash").alias(text_hash)).distinct())
    return without(docs.withColumn(text_hash, F.xxhash64("text")), rejected, "doc_id", (text_hash,)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds in an aligned block go; documents that lose all their text go with them."""
    # the counts must not replace columns of their names
    aside = {c: fresh(docs, f"own_{c}") for c in ("n_lines", "n_removed") if c in docs.columns}
    out = line_dedup.deduplicated(docs.withColumnsRenamed(aside))
    changed = F.col("n_removed") > 0
    out = out.where(~changed | (F.trim("text") != ""))
    length = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars")
    return out.select(*(length if c == "n_chars" else F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles (similarity 0.8 or more), that of the smallest id stays."""
    key = fresh(docs, "key")
    # beyond all ids, by text
    unnamed = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND((1 << 61) - 1)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), unnamed))
    joined = jaccard_join.joined(keyed.select(key, "text"), NEAR, key)
    gone = cut(joined.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct())
    return without(keyed, gone, key).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    key = fresh(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = decontamination.contaminated(keyed.select(key, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return without(keyed, cut(found.select(F.col("doc_id").alias(key)).distinct()), key).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture at its target weights, one row for each epoch that reads a document."""
    return mixing.mixture(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark),
    ("mixing", mix),
]

def _over(sql: str, documents: str) -> str:
    """SQL of an operator over another table of documents."""
    return re.sub(r"\bdocuments\b", documents, sql)


#: Each stage by the SQL of its operator over what its predecessor kept.
ORACLE_SQL = f"""
with s1 as materialized (select * from documents where doc_id in (select doc_id from ({quality_rules.ORACLE}) where kept)),
s2 as materialized (
  select s1.doc_id, x.text, lang, source, case when n_removed > 0 then length(x.text) else n_chars end n_chars
  from s1 join ({_over(line_dedup.ORACLE, "s1")}) x on x.doc_id = s1.doc_id where n_removed = 0 or trim(x.text, ' ') <> ''),
s3 as materialized (select * from s2 where doc_id in (select doc_id from ({_over(jaccard_join.oracle_for(NEAR), "s2")}) where doc_id = component_id)),
s4 as materialized (select * from s3 where doc_id not in (select doc_id from ({_over(decontamination.ORACLE, "s3")}))),
s5 as (select doc_id, unnest(range(copies)) epoch from ({_over(mixing.ORACLE, "s4")}))
select s4.doc_id, text, lang, source, n_chars, epoch::int epoch from s4 join s5 on s5.doc_id = s4.doc_id
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; what lies between two stages is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{own_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
