"""Queries over report texts (S1 to S6, T1 to T19) and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from traceqc.functions import text as T
from traceqc.operators import cohort
from traceqc.operators import reports as R
from traceqc.plans.fixtures import DOCUMENTS, TEXTS, WAVES, frame, plain
from traceqc.plans.scratch import scratch
from traceqc.sources import io

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def clean_sql(x: str) -> str:
    stripped = f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"
    out = f"regexp_replace({stripped}, '[ \\t]{{2,}}', '', 'g')"
    out = f"regexp_replace({out}, '([^A-Za-z0-9 \\t])[ \\t]', '\\1', 'g')"
    return f"regexp_replace({out}, '[ \\t]([^A-Za-z0-9 \\t])', '\\1', 'g')"


def field_sql(x: str, pattern: str) -> str:
    return clean_sql(f"regexp_extract({x}, '{pattern}', 1)")


def wrapped_sql(x: str) -> str:
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda y: {clean_sql('y')}), lambda y: y <> '')"
    glue = "i = 1 or regexp_matches(l[i-1], '[,，]$') or (not contains(y, '：') and not regexp_matches(l[i-1], '[。；;]$'))"
    return f"(select coalesce(array_to_string(list_transform(l, lambda y, i: case when {glue} then y else chr(10) || y end), ''), '') from (select {lines} l))"


PAGES_SQL = f"""
d as ({plain(DOCUMENTS)}),
s as (select source_file, string_split(case when ends_with(text, chr(12)) then left(text, length(text) - 1) else text end, chr(12)) p from d),
pages as (select source_file, len(p)::int n_pages, unnest(range(1, len(p) + 1))::int page_no, unnest(p) page_text from s)"""


def pages_of(spark, d):
    return io.pages(frame(spark, d, DOCUMENTS))


def sections_of(spark, d):
    return R.with_sections(pages_of(spark, d).where("page_no = 1"))


@query("s1_pages", f"with {PAGES_SQL} select source_file, n_pages, page_no, page_text from pages")
def s1(spark, d):
    return pages_of(spark, d)


HEAD = r"case when regexp_matches(page_text, '床号[:：][^\n]*\n') then regexp_extract(page_text, '(?s)^(.*?床号[:：][^\n]*\n)', 1) when contains(page_text, '脑电图：') then left(page_text, strpos(page_text, '脑电图：') - 1) else page_text end"
BODY = r"case when regexp_matches(page_text, '床号[:：][^\n]*\n') then substr(page_text, length(h) + 1) when contains(page_text, '脑电图：') then substr(page_text, length(h) + 5) else '' end"
SECTIONS_SQL = f"""{PAGES_SQL},
a as (select *, {HEAD} h from pages where page_no = 1),
b as (select *, regexp_replace(regexp_replace({BODY}, '^脑电图：', ''), '\\b(?:FP|F|C|P|O|T)\\d-[A-Z]+\\d\\b|标记', '', 'g') body from a),
c as (select *, case when contains(body, '脑电地形图：') then left(body, strpos(body, '脑电地形图：') - 1) else body end e0,
  case when contains(body, '脑电地形图：') then substr(body, strpos(body, '脑电地形图：') + 6) else '' end rest from b),
e as (select *, case when contains(rest, '结论：') then left(rest, strpos(rest, '结论：') - 1) else rest end topo,
  case when rest = '' then case when contains(e0, '结论：') then left(e0, strpos(e0, '结论：') - 1) else e0 end else e0 end eeg,
  case when rest = '' then case when contains(e0, '结论：') then substr(e0, strpos(e0, '结论：') + 3) else '' end
    when contains(rest, '结论：') then substr(rest, strpos(rest, '结论：') + 3) else '' end concl from c)"""
FIELDS_SQL = ", ".join(f"{field_sql('h', p)} {n}" for n, p in R.HEADER.items())
REPORTS_SQL = f"""{SECTIONS_SQL},
i as (select source_file, regexp_extract(t, '编号[:：]\\s*(\\d+)', 1) any_id from (select source_file, string_agg(page_text, chr(10) order by page_no) t from pages group by 1) where regexp_matches(t, '编号[:：]\\s*\\d+')),
r as (select source_file, n_pages, {FIELDS_SQL}, {wrapped_sql("regexp_replace(eeg, '(?m)^-{3,}.*$', '', 'g')")} eeg_text, {wrapped_sql("topo")} topo_text,
  {wrapped_sql("string_split_regex(concl, '仅供参考|起点[0-9]+秒|处理长度')[1]")} conclusion from e),
reports as (select r.* replace (coalesce(nullif(record_id, ''), any_id, '') as record_id) from r left join i using (source_file))"""


@query("t1_clean_names", f"select c_custkey, {clean_sql('x')} cleaned from (select c_custkey, concat('  ', c_mktsegment, ' ', c_name, '  ：', c_mktsegment, ' a b  c ') x from customer)")
def t1(spark, d):
    x = F.concat(F.lit("  "), "c_mktsegment", F.lit(" "), "c_name", F.lit("  ："), "c_mktsegment", F.lit(" a b  c "))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", T.clean(x).alias("cleaned"))


@query("t3_wrapped_lines", f"with {SECTIONS_SQL} select source_file, {wrapped_sql('eeg')} joined from e")
def t3(spark, d):
    return sections_of(spark, d).select("source_file", T.join_wrapped(F.col("eeg")).alias("joined"))


@query("t4_header_body", f"with {SECTIONS_SQL} select source_file, h header, body from e")
def t4(spark, d):
    return sections_of(spark, d).select("source_file", "header", "body")


@query("t6_sections", f"with {SECTIONS_SQL} select source_file, regexp_replace(eeg, '(?m)^-{{3,}}.*$', '', 'g') eeg, topo, string_split_regex(concl, '仅供参考|起点[0-9]+秒|处理长度')[1] conclusion from e")
def t6(spark, d):
    """Overlays, sections, cut conclusion, rule lines."""
    return sections_of(spark, d).select("source_file", T.without_rules(F.col("eeg")).alias("eeg"), "topo", T.cut_conclusion(F.col("conclusion")).alias("conclusion"))


@query("t9_reports", f"with {REPORTS_SQL} select * from reports")
def t9(spark, d):
    """One report row for each document."""
    return R.reports(pages_of(spark, d))


@query("t11_recordings", f"with {PAGES_SQL} select source_file, {', '.join(f'{field_sql("page_text", p)} {n}' for n, p in R.TIMES.items())} from pages where page_no = 1")
def t11(spark, d):
    return R.recordings(pages_of(spark, d))


FOOT = R.FOOTER.removeprefix("(?U)")
WAVES_SQL = f"""{PAGES_SQL},
f as (select source_file, contains(page_text, '姓名')::int has_report from pages where page_no = 1),
x as (select pages.*, page_no - has_report wave_idx, list_filter(list_transform(string_split(page_text, chr(10)), lambda y: trim(y)), lambda y: y <> '') l from pages join f using (source_file)
  where page_no > has_report and not (contains(page_text, '姓名') and contains(page_text, '脑电图'))),
y as (select *, list_filter(l, lambda y: regexp_matches(y, '^[A-Za-z0-9]+-[A-Za-z0-9]+$')) channels, regexp_extract(page_text, '{FOOT}', ['a', 'b', 'c', 'd', 'e', 'g']) m,
  regexp_matches(page_text, '{FOOT}') has from x),
waves as (select source_file, page_no, wave_idx, channels, list_contains(l, '标记') marker_row, m.a time_in_record, m.b clock_time, m.c stage, m.d sensitivity, m.e speed from y where len(channels) > 0 or has)"""


@query("t12_waveform_pages", f"with {WAVES_SQL} select source_file, page_no, wave_idx, array_to_string(channels, ',') channels, marker_row, time_in_record, clock_time, stage, sensitivity, speed from waves")
def t12(spark, d):
    """Waveform pages and their index."""
    return R.waveform_pages(pages_of(spark, d)).withColumn("channels", F.array_join("channels", ","))


NESTED_SQL = f"""with {REPORTS_SQL.strip()}, {WAVES_SQL.replace(PAGES_SQL, "").lstrip().removeprefix(",")}
select r.source_file, r.record_id, count(w.page_no)::int n_waves, coalesce(string_agg(w.wave_idx || ':' || array_to_string(w.channels, ',') || ':' || w.stage, '|' order by w.wave_idx), '') waves
from reports r left join waves w using (source_file) group by all"""


def flat_waves(df):
    shown = F.transform("waveforms", lambda w: F.concat(w["page"].cast("string"), F.lit(":"), F.array_join(w["channels"], ","), F.lit(":"), w["stage"]))
    return df.select("source_file", "record_id", F.size("waveforms").alias("n_waves"), F.array_join(shown, "|").alias("waves"))


@query("t14_nested", NESTED_SQL)
def t14(spark, d):
    return flat_waves(R.nested(pages_of(spark, d)))


@query("s3_waveform_json", NESTED_SQL)
def s3(spark, d):
    """Nested records written as JSON and read back."""
    path = scratch(spark, "json")
    io.write_waveforms(R.nested(pages_of(spark, d)), path)
    return flat_waves(io.read_waveforms(spark, path))


LATEST_SQL = f"with {REPORTS_SQL} select case when length(record_id) > 2 then left(record_id, length(record_id) - 1) else record_id end key, max(source_file) source_file, count(*) n from reports group by 1"


@query("s4_latest_report", f"select key, source_file from ({LATEST_SQL})")
def s4(spark, d):
    """Of documents with one key, that of the last file stays."""
    key = F.when(F.length("record_id") > 2, F.left("record_id", F.length("record_id") - 1)).otherwise(F.col("record_id"))
    return io.latest(R.reports(pages_of(spark, d)).select(key.alias("key"), "source_file"), "key")


SECOND = "cast(substr(source_file, 2, 9) as int) % 3 = 0"


@query("s4_upsert", f"select key, coalesce(max(source_file) filter ({SECOND}), max(source_file)) source_file, bool_or({SECOND}) replaced from (select * exclude (record_id), case when length(record_id) > 2 then left(record_id, length(record_id) - 1) else record_id end key from (with {REPORTS_SQL} select source_file, record_id from reports)) group by 1")
def s4_upsert(spark, d):
    """Reports in two batches, written one after the other: of documents with one key that of the later batch stays."""
    key = F.when(F.length("record_id") > 2, F.left("record_id", F.length("record_id") - 1)).otherwise(F.col("record_id"))
    rows = R.reports(pages_of(spark, d)).select(key.alias("key"), "source_file", F.expr(SECOND).alias("replaced"))
    path = scratch(spark, "records")
    for batch in (~F.col("replaced"), F.col("replaced")):
        io.upsert(rows.where(batch), path, "key", parts=16)
    return io.read_records(spark, path)


@query("s2_csv_round_trip", f"with {REPORTS_SQL} select source_file, nullif(name, '') name, nullif(medication, '') medication, nullif(eeg_text, '') eeg_text, nullif(conclusion, '') conclusion from reports")
def s2(spark, d):
    """Reports written as CSV and read back as strings; what was empty is null."""
    columns = ["source_file", "name", "medication", "eeg_text", "conclusion"]
    path = scratch(spark, "csv")
    io.write_csv(R.reports(pages_of(spark, d)).select(*columns), path)
    return io.read_csv(spark, path, columns)


COLUMNS = ["source_file", "n_pages", *R.HEADER, "eeg_text", "topo_text", "conclusion"]


def qa_sql() -> str:
    parts = ["select 'rows' measure, '' \"column\", count(*) n from reports", f"select 'columns', '', {len(COLUMNS)}", "select 'repeated', 'record_id', count(*) - count(distinct record_id) from reports"]
    parts += [f"select '{m}', '{c}', count(*) from reports where {t} having count(*) > 0" for c in COLUMNS for m, t in (("null", f"{c} is null"), ("empty", f"{c}::varchar = ''"))]
    return f"with {REPORTS_SQL} " + " union all ".join(parts)


@query("t15_extraction_qa", qa_sql())
def t15(spark, d):
    return R.extraction_qa(R.reports(pages_of(spark, d)))


SMALL = "select l_orderkey, l_linenumber, case when l_partkey%13=0 then '' when l_partkey%5=0 then concat(cast(l_quantity as string), 'mm') when l_linestatus='F' then concat(cast(l_suppkey as string), 'uV/', cast(l_linenumber as string), '.5mm x') else concat('ab', cast(l_partkey as string), '秒12') end x from {lineitem}"


@query("t16_seconds", f"select l_orderkey, l_linenumber, x, try_cast(nullif(regexp_extract(x, '\\d+'), '') as int) sec from ({plain(SMALL)})")
def t16(spark, d):
    return frame(spark, d, SMALL).withColumn("sec", T.seconds(F.col("x")))


@query("t17_sensitivity", r"select l_orderkey, l_linenumber, x, try_cast(nullif(regexp_extract(x, '^(\d+(?:\.\d+)?)uV/(\d+(?:\.\d+)?)mm', 1), '') as double) uv, try_cast(nullif(regexp_extract(x, '^(\d+(?:\.\d+)?)uV/(\d+(?:\.\d+)?)mm', 2), '') as double) mm from (" + plain(SMALL) + ")")
def t17(spark, d):
    uv, mm = T.sensitivity(F.col("x"))
    return frame(spark, d, SMALL).withColumns({"uv": uv, "mm": mm})


WORDS = "select l_orderkey, l_linenumber, l_partkey, case l_partkey%9 when 0 then '标记' when 1 then concat(cast(l_suppkey as string), '秒') when 2 then '10:00:05' when 3 then concat('编号:', cast(l_orderkey as string)) when 4 then 'O1-A1' when 5 then '50uV/3.5mm' when 6 then concat('note', cast(l_suppkey as string)) when 7 then '3厘米/秒 x' else '滤波' end text from {lineitem}"


@query("t18_unknown_words", f"select * from ({plain(WORDS)}) where not regexp_matches(text, '{T.KNOWN_TEXT.removeprefix('(?U)')}')")
def t18(spark, d):
    """Words on a page that aren't known texts."""
    return frame(spark, d, WORDS).where(~T.is_known(F.col("text")))


@query("t19_text_search", f"with t as ({plain(TEXTS)}) select count(*) filter (regexp_matches(text, '{T.FILTER_WORDS}')) hits, count(distinct rec) filter (regexp_matches(text, '{T.FILTER_WORDS}')) records, array_to_string(list_sort(list(distinct text) filter (regexp_matches(text, '{T.FILTER_WORDS}'))), '|') texts, count(*) filter (not contains(text, '滤波')) others from t")
def t19(spark, d):
    return cohort.text_search(frame(spark, d, TEXTS))


@query("s5_signal_store", "select cast(floor(vec_id/13) as int) trace_id, len(flatten(list(embedding order by vec_id)))::int n, round(list_sum(flatten(list(embedding order by vec_id))::double[]), 4) total from embeddings group by 1")
def s5(spark, d):
    """Signals written as arrays of floats and read back."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    traces = e.groupBy(F.floor(F.col("vec_id") / 13).cast("int").alias("trace_id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])).alias("samples"))
    path = scratch(spark, "signals")
    io.write_signals(traces, path)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return io.read_signals(spark, path).select("trace_id", F.size("samples").alias("n"), F.round(total, 4).alias("total"))


#: A trace of 13 vectors a page, four pages a record.
TRACES = "select cast(cast(floor(vec_id/52) as bigint) as string) rec, cast(floor(vec_id/13) as bigint) % 4 page_no, vec_id, label, embedding from {embeddings}"
SHARDS = 16


@query(
    "s5_signals_of_pages",
    f"with t as ({plain(TRACES)}), p as (select rec, page_no, max_by(label, vec_id) last from t group by 1, 2) select rec, page_no, len(flatten(list(embedding order by vec_id)))::int n, round(list_sum(flatten(list(embedding order by vec_id))::double[]), 4) total from t join p using (rec, page_no) where last > 1 group by 1, 2",
)
def s5_pages(spark, d):
    """Signals in a table by page, of which the pages are read whose last vector has a label above 1."""
    t = frame(spark, d, TRACES)
    signals = t.groupBy("rec", "page_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])).alias("samples"))
    wanted = t.groupBy("rec", "page_no").agg(F.max_by("label", "vec_id").alias("last")).where("last > 1")
    table = f"signals_{uuid.uuid4().hex}"
    io.write_signal_table(signals, table, scratch(spark, "signals"), SHARDS)
    stored = spark.table(table)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return io.signals_of(stored, wanted, SHARDS).select("rec", "page_no", F.size("samples").alias("n"), F.round(total, 4).alias("total"))
