"""From document pages to report rows, record ids, and waveform pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceqc.functions import text as T

B = r"[ \t]*"  # fields stand on one line; an empty one doesn't take the next line

#: column: pattern of the header fields (fixed values)
HEADER = {
    "name": rf"姓名[:：]{B}(\S*)",
    "age": rf"年龄[:：]{B}(\d*)",
    "sex": rf"性别[:：]{B}(\S*)",
    "record_id": rf"编号[:：]{B}(\d*)",
    "handedness": rf"左右利[:：]{B}(\S*)",
    "cooperation": rf"合作[:：]{B}(\S*)",
    "exam_date": rf"检查日期[:：]{B}([\d-]*)",
    "consciousness": rf"意识[:：]{B}(\S*)",
    "medication": rf"药物[:：]{B}(\S*)",
    "diagnosis": rf"临床诊断[:：]{B}(.*)",
}
#: fields of page 1 that describe the recording; these may cross lines (fixed values)
TIMES = {
    "examiner": r"检查者[:：]\s*(\S+)",
    "start": r"起点\s*(\d+秒)\s*[\d:]+",
    "start_time": r"起点\s*\d+秒\s*([\d:]+)",
    "length": r"处理长度\s*(\d+秒)",
}
#: The footer of a waveform page (fixed value) and its groups.
FOOTER = r"(?U)(\d+)秒\s+([\d:]+)\s+(\S+)\s+(\S+)\s+(\S+)\s+编号[:：]\s*(\d+)"
FOOTER_FIELDS = ["time_in_record", "clock_time", "stage", "sensitivity", "speed"]


def with_sections(first_pages: DataFrame, text: str = "page_text") -> DataFrame:
    """Adds header, body (without overlays), eeg, topo and conclusion of report pages.

    Each is made once, from columns of the step before, so that no pattern is matched again for each field.
    """
    header, body = T.header_and_body(F.col(text), F.col("_head"))
    df = first_pages.withColumn("_head", T.bed_line(F.col(text))).withColumns({"header": header, "body": body}).withColumn("body", T.without_overlays(F.col("body")))
    eeg, topo, conclusion = T.sections(F.col("body"))
    return df.withColumns({"eeg": eeg, "topo": topo, "conclusion": conclusion}).drop("_head")


RECORD_ID = r"编号[:：]\s*"


def any_record_id(pages: DataFrame) -> DataFrame:
    """(source_file, any_id): the first record id in the pages of a document read as one text; none, no row.

    The label may end a page and the id begin the next one that isn't blank. Only ids and what stands at both ends
    of a page are exchanged, never texts.
    """
    text = F.col("page_text")
    slim = pages.select(
        "source_file",
        "page_no",
        F.nullif(F.regexp_extract(text, rf"(?U){RECORD_ID}(\d+)", 1), F.lit("")).alias("own"),
        text.rlike(rf"(?U){RECORD_ID}$").alias("open"),
        F.when(text.rlike(r"(?U)\S"), F.regexp_extract(text, r"(?U)^\s*(\d*)", 1)).alias("digits"),
    )
    later = Window.partitionBy("source_file").orderBy("page_no").rowsBetween(1, Window.unboundedFollowing)
    carried = F.when(F.col("open"), F.nullif(F.first("digits", True).over(later), F.lit("")))
    found = slim.withColumn("id", F.coalesce("own", carried)).where("id is not null")
    return found.groupBy("source_file").agg(F.min_by("id", "page_no").alias("any_id"))


def reports(pages: DataFrame) -> DataFrame:
    """One row for each document, from its first page; an absent record id is taken from all pages."""
    first = with_sections(pages.where("page_no = 1").select("source_file", "n_pages", "page_text"))
    texts = {"eeg_text": T.join_wrapped(T.without_rules(F.col("eeg"))), "topo_text": T.join_wrapped(F.col("topo")), "conclusion": T.join_wrapped(T.cut_conclusion(F.col("conclusion")))}
    own = first.select("source_file", "n_pages", *(T.field(F.col("header"), p).alias(n) for n, p in HEADER.items()), *(c.alias(n) for n, c in texts.items()))
    return own.join(any_record_id(pages), "source_file", "left").withColumn("record_id", F.coalesce(F.nullif("record_id", F.lit("")), "any_id", F.lit(""))).drop("any_id")


def recordings(pages: DataFrame) -> DataFrame:
    """Examiner, start and length of each document, from its first page."""
    return pages.where("page_no = 1").select("source_file", *(T.field(F.col("page_text"), p).alias(n) for n, p in TIMES.items()))


def waveform_pages(pages: DataFrame) -> DataFrame:
    """Waveform pages with their index: all pages but a first one that is a report; repeated report pages have an index
    but are no waveform pages, as are pages with neither channels nor footer."""
    first = pages.where("page_no = 1").select("source_file", F.col("page_text").contains("姓名").cast("int").alias("has_report"))
    lines = F.filter(F.transform(F.split("page_text", T.LINE_END), T.strip), lambda x: x != "")
    out = pages.join(first, "source_file").withColumn("wave_idx", F.col("page_no") - F.col("has_report")).where("wave_idx > 0")
    out = out.where(~(F.col("page_text").contains("姓名") & F.col("page_text").contains("脑电图"))).withColumn("lines", lines)
    out = out.withColumn("channels", F.filter("lines", lambda x: x.rlike(T.CHANNEL))).withColumn("footer", F.regexp_extract("page_text", FOOTER, 0))
    out = out.where((F.size("channels") > 0) | (F.col("footer") != ""))
    fields = [F.regexp_extract("page_text", FOOTER, g + 1).alias(n) for g, n in enumerate(FOOTER_FIELDS)]
    return out.select("source_file", "page_no", "wave_idx", "channels", F.array_contains("lines", "标记").alias("marker_row"), *fields)


def nested(pages: DataFrame) -> DataFrame:
    """One record for each document with its waveform pages in order; an empty list where there are none."""
    row = F.struct(F.col("wave_idx").alias("page"), "channels", "marker_row", *FOOTER_FIELDS)
    waves = waveform_pages(pages).groupBy("source_file").agg(F.array_sort(F.collect_list(row)).alias("waveforms"))
    own = reports(pages).select("source_file", "record_id", "name").join(recordings(pages), "source_file").join(waves, "source_file", "left")
    empty = F.array().cast(waves.schema["waveforms"].dataType)
    return own.withColumn("waveforms", F.coalesce("waveforms", empty))


def extraction_qa(df: DataFrame, key: str = "record_id") -> DataFrame:
    """(measure, column, n): rows, columns, repeated keys, and nulls and empty strings of each column that has any."""
    columns = df.columns
    counted = df.agg(
        F.count("*").alias("rows"),
        F.countDistinct(key).alias("keys"),
        F.max(F.col(key).isNull().cast("int")).alias("null_key"),
        *(F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in columns),
        *(F.count_if(F.col(c).cast("string") == "").alias(f"empty:{c}") for c in columns),
    )
    entry = lambda measure, column, n: F.struct(F.lit(measure).alias("measure"), F.lit(column).alias("column"), n.cast("long").alias("n"))
    distinct = F.col("keys") + F.coalesce("null_key", F.lit(0))
    always = F.array(entry("rows", "", F.col("rows")), entry("columns", "", F.lit(len(columns))), entry("repeated", key, F.col("rows") - distinct))
    found = F.filter(F.array(*(entry(m, c, F.col(f"`{m}:{c}`")) for m in ("null", "empty") for c in columns)), lambda x: x["n"] > 0)
    return counted.select(F.inline(F.concat(always, found)))
