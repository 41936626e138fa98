"""Queries over linkage (L1 to L9) and dates (D1 to D11) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceqc.operators import dates as D
from traceqc.operators import linkage as L
from traceqc.plans.fixtures import EXAMS, MANUAL, REPORTS, SUBJECTS, VISITS, frame, plain
from traceqc.plans.scratch import scratch
from traceqc.sources import io

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


U = f"""s as (select subject_id, trim(name) "name", trim(age) age, trim(sex) sex from ({plain(SUBJECTS)})),
u as (select "name", age, sex, any_value(subject_id) subject_id from s group by 1, 2, 3 having count(*) = 1),
r as ({plain(REPORTS)}),
t1 as (select r.*, u.subject_id id1 from r left join u on r."name" is not distinct from u."name" and r.age is not distinct from u.age and r.sex is not distinct from u.sex),
b as (select t1.source_file, any_value(u.subject_id) id2 from t1 join u on t1."name" = u."name" and t1.sex = u.sex and abs(try_cast(u.age as double) - try_cast(t1.age as double)) <= 2 where id1 is null group by 1 having count(*) = 1),
m as ({plain(MANUAL)}),
linked as (select t1.source_file, t1.record_id, t1."name", t1.sex, t1.age, case when m.record_id is not null then m.subject_id else coalesce(id1, id2) end subject_id,
  case when m.record_id is not null then 'manual' when id1 is not null then 'name+age+sex' when b.source_file is not null then 'name+sex+age<=2' else '' end match_method
  from t1 left join b on b.source_file = t1.source_file left join m on m.record_id = t1.record_id)"""


def parts(spark, d):
    return frame(spark, d, REPORTS), frame(spark, d, SUBJECTS), frame(spark, d, MANUAL)


@query("l2_ambiguous_subjects", f"with {U} select coalesce(sum(n), 0)::bigint ambiguous from (select count(*) n from s group by \"name\", age, sex having count(*) > 1)")
def l2(spark, d):
    """L1 and L2."""
    return L.ambiguous_count(parts(spark, d)[1])


@query("l3_unique_subjects", f"with {U} select * from u")
def l3(spark, d):
    return L.unique_subjects(parts(spark, d)[1])


@query("l4_exact_match", f"with {U} select source_file, id1 subject_id from t1")
def l4(spark, d):
    reports, subjects, _ = parts(spark, d)
    return L.exact(L.stripped(reports), L.unique_subjects(subjects)).select("source_file", "subject_id")


@query("l5_age_band_match", f"with {U} select source_file, id2 subject_id from b")
def l5(spark, d):
    reports, subjects, _ = parts(spark, d)
    unique = L.unique_subjects(subjects)
    return L.age_band(L.exact(L.stripped(reports), unique).where("subject_id is null"), unique, "source_file")


@query("l7_linked_reports", f"with {U} select * from linked")
def l7(spark, d):
    """All tiers, manual matches, and the method."""
    return L.linked(*parts(spark, d))


@query("s6_subject_ingest", f"with {U} select * from linked")
def s6(spark, d):
    """Subjects and manual matches written as CSV, read as strings, and linked."""
    reports, subjects, manual = parts(spark, d)
    paths = [scratch(spark, name) for name in ("subjects", "manual")]
    io.write_csv(subjects.select(*io.SUBJECT_COLUMNS), paths[0])
    io.write_csv(manual.select(*io.MANUAL_COLUMNS), paths[1])
    return L.linked(reports, io.read_subjects(spark, paths[0]), io.read_manual(spark, paths[1]))


@query("s6_without_manual", f"with {U} select source_file, coalesce(id1, id2) subject_id, case when id1 is not null then 'name+age+sex' when b.source_file is not null then 'name+sex+age<=2' else '' end match_method from t1 left join b using (source_file)")
def s6_without(spark, d):
    """The manual table may be absent."""
    reports, subjects, _ = parts(spark, d)
    return L.linked(reports, subjects, io.read_manual(spark, scratch(spark, "absent"))).select("source_file", "subject_id", "match_method")


@query("l8_coverage", f"with {U} select count(*) total, count(subject_id) matched, count(*) - count(subject_id) unmatched from linked")
def l8(spark, d):
    return L.coverage(L.linked(*parts(spark, d)))


@query("l8_unmatched", f"with {U} select \"name\", age, sex, record_id, source_file from linked where subject_id is null")
def l8_rows(spark, d):
    return L.unmatched(L.linked(*parts(spark, d)))


@query("l9_linked_twice", f"with {U} select * from linked")
def l9(spark, d):
    """Linking what is linked already changes nothing."""
    reports, subjects, manual = parts(spark, d)
    return L.linked(L.linked(reports, subjects, manual), subjects, manual).select("source_file", "record_id", "name", "sex", "age", "subject_id", "match_method")


G = f"""e as ({plain(EXAMS)}),
v as ({plain(VISITS)}),
f as (select subject_id, arg_min(record_id, source_file) record_id, arg_min(coalesce(exam_date, '~'), source_file) x from e where subject_id is not null group by 1),
j as (select v.*, record_id, try_strptime(nullif(x, '~'), '%Y-%m-%d') pdf, try_strptime(eeg_time, '%Y-%m-%d') own from v left join f using (subject_id)),
gaps as (select subject_id, record_id, test_time::date test_date, eeg_time eeg_date_original, coalesce(pdf, own)::date eeg_date,
  case when pdf is not null then 'report' when own is not null then 'original' else 'missing' end eeg_date_source,
  floor(epoch(test_time - coalesce(pdf, own)) / 86400)::int gap_days, (pdf is not null and pdf is distinct from own)::int eeg_date_changed, own is null no_own from j)"""


def gaps(spark, d):
    return D.reconciled(frame(spark, d, VISITS), frame(spark, d, EXAMS))


@query("d1_lenient_dates", f"with e as ({plain(EXAMS)}) select source_file, exam_date, try_strptime(exam_date, '%Y-%m-%d')::date parsed from e")
def d1(spark, d):
    return frame(spark, d, EXAMS).select("source_file", "exam_date", D.lenient(F.col("exam_date")).cast("date").alias("parsed"))


#: Dates of orders as one column of mixed formats, with texts that are none.
MIXED = """select o_orderkey, case when o_orderkey%11 = 0 then null when o_orderkey%13 = 0 then 'n/a' when o_orderkey%5 = 1 then replace(substr(cast(o_orderdate as string), 1, 10), '-', '/')
  when o_orderkey%7 = 2 then replace(substr(cast(o_orderdate as string), 1, 10), '-', '') else substr(cast(o_orderdate as string), 1, 10) end given from {orders}"""
MIXED_FORMATS = {"y/M/d": "%Y/%m/%d", "yyyyMMdd": "%Y%m%d", "y-M-d": "%Y-%m-%d"}


def inferred_sql(choice: str) -> str:
    """Each value in the format whose number ``choice`` gives."""
    case = " ".join(f"when {k} then try_strptime(given, '{f}')" for k, f in enumerate(MIXED_FORMATS.values()))
    return f"with m as ({plain(MIXED)}), c as ({choice}) select o_orderkey, given, case k {case} end::date parsed from m, c"


VOTES = "select k from (select unnest([" + ", ".join(f"count(try_strptime(given, '{f}'))" for f in MIXED_FORMATS.values()) + "]) n, unnest([0, 1, 2]) k from m) order by n desc, k limit 1"
FIRST = "select case " + " ".join(f"when try_strptime(given, '{f}') is not null then {k}" for k, f in enumerate(MIXED_FORMATS.values())) + " end k from m where given is not null order by o_orderkey limit 1"


@query("d1_format_by_votes", inferred_sql(VOTES))
def d1_votes(spark, d):
    out = D.with_inferred(frame(spark, d, MIXED), "given", "parsed", tuple(MIXED_FORMATS))
    return out.withColumn("parsed", F.to_date("parsed"))


@query("d1_format_of_first", inferred_sql(FIRST))
def d1_first(spark, d):
    out = D.with_inferred(frame(spark, d, MIXED), "given", "parsed", tuple(MIXED_FORMATS), F.col("o_orderkey"))
    return out.withColumn("parsed", F.to_date("parsed"))


@query("d2_first_report", f"with {G} select subject_id, record_id, nullif(x, '~') exam_date from f")
def d2(spark, d):
    return D.first_reports(frame(spark, d, EXAMS))


@query("d7_date_gaps", f"with {G} select * exclude no_own from gaps")
def d7(spark, d):
    """Lookup, updated date, where it comes from, gap, changed or not."""
    return gaps(spark, d).drop("_no_own")


QUANTILES = ", ".join(f"round(quantile_cont(gap_days, {q})) q{n}" for q, n in ((0.05, "05"), (0.25, "25"), (0.5, "50"), (0.75, "75"), (0.95, "95")))


@query("d8_gap_summary", f"with {G} select count(gap_days) n, avg(gap_days) mean, median(gap_days) median, stddev_samp(gap_days) sd, min(gap_days) \"min\", max(gap_days) \"max\", {QUANTILES}, count(*) filter (gap_days < 0) negative, count(*) filter (gap_days = 0) zero, count(*) filter (gap_days > 30) over_30, count(*) filter (gap_days > 90) over_90, count(*) filter (gap_days is null) no_gap, count(*) filter (eeg_date_changed = 1) changed, count(*) filter (eeg_date_source = 'report' and no_own) changed_without_original from gaps")
def d8(spark, d):
    return D.gap_summary(gaps(spark, d))


@query("d8_by_source", f"with {G} select eeg_date_source, count(*) n from gaps group by 1")
def d8_sources(spark, d):
    return D.by_source(gaps(spark, d))


@query("d9_exceptions", f"with {G} select subject_id, gap_days, coalesce(gap_days < 0 or gap_days > 30, true) odd_gap, eeg_date_changed = 1 changed from gaps where coalesce(gap_days < 0 or gap_days > 30, true) or eeg_date_changed = 1")
def d9(spark, d):
    return D.exceptions(gaps(spark, d))


TABLE = "select c_custkey, case when c_custkey%50=0 then null else cast(c_custkey*3 as string) end subject_id, 'old' gap_days from {customer}"
MERGED = f"{G}, t as ({plain(TABLE)}), merged as (select t.c_custkey, t.subject_id, eeg_date, eeg_date_source, eeg_date_changed, g.gap_days from t left join gaps g on t.subject_id is not distinct from g.subject_id)"


@query("d10_merged", f"with {MERGED} select * from merged")
def d10(spark, d):
    return D.merged(frame(spark, d, TABLE), gaps(spark, d))


@query("d11_merge_summary", f"with {MERGED} select count(*) total, count(gap_days) with_gap, count(*) - count(gap_days) without_gap, median(gap_days) median, min(gap_days) \"min\", max(gap_days) \"max\" from merged")
def d11(spark, d):
    return D.merge_summary(D.merged(frame(spark, d, TABLE), gaps(spark, d)))
