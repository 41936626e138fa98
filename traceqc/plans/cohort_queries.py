"""Queries over cohort summaries (C1 to C31) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceqc.functions import stats
from traceqc.operators import cohort as C
from traceqc.plans.fixtures import CHANNELS, PAGES, TEXTS, WAVES, frame, plain

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


RECORDS = "select cast(o_orderkey as string) rec, case when o_orderkey%11=0 then '' else concat(cast(o_orderkey%40 as string), '秒') end start, case when o_orderkey%9=0 then '' when o_orderkey%10=0 then '0秒' else concat(cast(8*(1+o_orderkey%5) as string), '秒') end length, concat('医生', cast(o_orderkey%7 as string)) examiner from {orders}"
W = f"w as (select *, case when channels = '' then [] else string_split(channels, ',') end c from ({plain(WAVES)}))"
P, CH = f"p as ({plain(PAGES)})", f"c as ({plain(CHANNELS)})"
R = f"r as ({plain(RECORDS)})"
E = f"{P}, {CH}, e as (select c.*, stage, sensitivity, montage, try_cast(nullif(regexp_extract(time_in_record, '[0-9]+'), '') as int) sec0 from c join p using (rec, page_no))"


def waves(spark, d):
    return frame(spark, d, WAVES).withColumn("channels", F.when(F.col("channels") == "", F.array().cast("array<string>")).otherwise(F.split("channels", ",")))


def records(spark, d):
    """Records with their nested waveform lists."""
    row = F.struct("wave_idx", "channels", "stage", "sensitivity", "speed", "marker_row")
    lists = waves(spark, d).groupBy("rec").agg(F.array_sort(F.collect_list(row)).alias("waveforms"))
    return frame(spark, d, RECORDS).join(lists, "rec", "left").withColumn("waveforms", F.coalesce("waveforms", F.array().cast(lists.schema["waveforms"].dataType)))


def pages(spark, d):
    return frame(spark, d, PAGES)


def channels(spark, d):
    return frame(spark, d, CHANNELS)


def enriched(spark, d):
    return C.enriched(channels(spark, d), pages(spark, d))


def rounded(df, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("c1_frequencies", f"with {P}, f as (select stage || '/' || n_points \"value\", count(*) n, min(rec || '-' || page_no) o from p group by 1) select \"value\", n, round(n / (select sum(n) from f), 6) share, greatest((select count(*) from f) - 4, 0) further from f order by n desc, o limit 4")
def c1(spark, d):
    value = F.concat("stage", F.lit("/"), F.col("n_points").cast("string"))
    return rounded(stats.frequencies(pages(spark, d), value, F.concat("rec", F.lit("-"), F.col("page_no").cast("string")), top=4))


PROFILED = ["std_uV", "ptp_uV", "flat_frac", "clip_frac", "zcr_hz", "hf_40_49", "off_center_pt"]


def profile_sql(metrics: list[str], source: str = "c") -> str:
    q = ", ".join(f"round(quantile_cont(v, {p}), 6) p{round(100 * p)}" for p in stats.QUANTILES)
    rows = " union all ".join(f"select '{m}' metric, {m}::double v from {source}" for m in metrics)
    return f"select metric, count(v) n, {q}, round(min(v), 6) \"min\", round(max(v), 6) \"max\" from ({rows}) where v is not null group by 1"


@query("c15_channel_profile", f"with {CH} {profile_sql(PROFILED)}")
def c15(spark, d):
    """Quantile profiles of channel metrics."""
    return rounded(stats.profile(channels(spark, d), PROFILED))


@query("c28_alpha_profile", f"with {CH} {profile_sql(['alpha_seg_cv', 'n_levels'])}")
def c28(spark, d):
    return rounded(stats.profile(channels(spark, d), ["alpha_seg_cv", "n_levels"]))


def z_sql(metric: str, log: bool, name: str, source: str = "c") -> str:
    v = f"log10(greatest({metric}, 1e-6))" if log else metric
    return f"{name}_v as (select *, case when {metric} is not null then {v} end v from {source}), {name}_m as (select ch, median(v) m from {name}_v group by 1), {name}_s as (select ch, m, median(abs(v - m)) s from {name}_v join {name}_m using (ch) group by 1, 2), {name} as (select {name}_v.*, (v - m) / (1.4826 * s + 1e-12) z from {name}_v join {name}_s using (ch))"


@query("c3_robust_outliers", f"with {CH}, {z_sql('zcr_hz', False, 'a')} select rec, page_no, ch, round(z, 6) z from a where abs(z) > 1.2")
def c3(spark, d):
    return rounded(stats.robust_z(channels(spark, d), "zcr_hz").where(F.abs("z") > 1.2).select("rec", "page_no", "ch", "z"))


@query("c14_spectral_outliers", f"with {CH}, {z_sql('p_hf_ratio', True, 'a')}, {z_sql('p_lo_ratio', True, 'b')} select 'p_hf_ratio' metric, count(*) rows, count(distinct rec || '-' || page_no) pages from a where abs(z) > 2 union all select 'p_lo_ratio', count(*), count(distinct rec || '-' || page_no) from b where abs(z) > 2")
def c14(spark, d):
    c = channels(spark, d)
    return C.outlier_counts(c, "p_hf_ratio", 2, True).union(C.outlier_counts(c, "p_lo_ratio", 2, True))


@query("c14_spectral_shape", f"with {CH} select round(median(hf_40_49), 9) hf_median, round(quantile_cont(hf_40_49, 0.99), 9) hf_p99, round(median(p_hf_ratio), 9) ratio_median from c")
def c14_shape(spark, d):
    return rounded(C.spectral_shape(channels(spark, d)), 9)


MONTAGE = "case when c[1] like '%A1' then 'A1/A2参考' when contains(c[1], 'REF') then 'REF' else '双极' end"


@query("c5_montage_pages", f"with {W} select rec, page_no, {MONTAGE} montage from w")
def c5(spark, d):
    """Montage of each page by its running index."""
    return C.with_montage(pages(spark, d), waves(spark, d)).select("rec", "page_no", "montage")


@query("c5_enriched_channels", f"with {E} select rec, page_no, ch, stage, sensitivity, montage, sec0 from e")
def c5_channels(spark, d):
    return enriched(spark, d).select("rec", "page_no", "ch", "stage", "sensitivity", "montage", "sec0")


@query("c6_pages_per_record", f"with {W}, {R}, n as (select rec, count(w.rec)::int n_pages from r left join w using (rec) group by 1) select n_pages, count(*) n_records from n group by 1")
def c6(spark, d):
    return C.pages_per_record(records(spark, d))


@query("c6_channel_shares", f"with {W}, {R} select ch, count(distinct rec) n, round(count(distinct rec) / (select count(*) from r), 9) share from (select rec, unnest(c) ch from w) group by 1")
def c6_shares(spark, d):
    return rounded(C.channel_shares(waves(spark, d), frame(spark, d, RECORDS)), 9)


@query("c6_channel_tuples", f"with {W} select channels, case when len(list_filter(c, lambda x: x like '%A1' or x like '%A2')) > 0 then 'A1/A2参考' when len(c) > 0 then '双极' else '' end kind, count(*) n, round(count(*) / (select count(*) from w), 9) share from w group by 1, 2 order by n desc, channels limit 5")
def c6_tuples(spark, d):
    return rounded(C.tuples(waves(spark, d)), 9)


LISTS = f"{W}, {R}, l as (select r.rec, r.start, r.length, r.examiner, coalesce(list(w.channels order by wave_idx) filter (w.rec is not null), []) a, coalesce(list(len(list_distinct(w.c)) order by wave_idx) filter (w.rec is not null), []) k, coalesce(flatten(list(w.c order by wave_idx) filter (w.rec is not null)), []) f, coalesce(list(stage order by wave_idx) filter (w.rec is not null), []) st, coalesce(list(sensitivity order by wave_idx) filter (w.rec is not null), []) se, coalesce(list(speed order by wave_idx) filter (w.rec is not null), []) sp from r left join w using (rec) group by all)"


@query("c7_sequences", f"with {LISTS} select array_to_string(a, ' | ') pages, count(*) n, any_value(array_to_string(k, ' | ')) sizes from l group by a")
def c7(spark, d):
    return C.sequences(records(spark, d))


@query("c8_merged_sets", f"with {LISTS} select array_to_string(list_sort(list_distinct(f)), ',') channels, count(*) n from l group by 1")
def c8(spark, d):
    return C.merged_sets(records(spark, d))


SEC = "try_cast(nullif(regexp_extract({x}, '[0-9]+'), '') as int)"


@query("c9_seconds", f"with {R}, {P} " + " union all ".join(f"select '{n}' field, count(*) total, count({SEC.format(x=n)}) n, round(avg({SEC.format(x=n)}), 6) mean, median({SEC.format(x=n)}) median, min({SEC.format(x=n)}) \"min\", max({SEC.format(x=n)}) \"max\" from {t}" for n, t in (("start", "r"), ("length", "r"), ("time_in_record", "p"))))
def c9(spark, d):
    r, p = frame(spark, d, RECORDS), pages(spark, d)
    parts = [rounded(C.second_summary(df, n)).select(F.lit(n).alias("field"), "*") for n, df in (("start", r), ("length", r), ("time_in_record", p))]
    return parts[0].union(parts[1]).union(parts[2])


@query("c10_consistency", f"with {LISTS} " + " union all ".join(f"select '{n}' \"key\", sum((len(list_distinct({c})) <= 1)::int)::bigint consistent, count(*) records, (select count(distinct {n}) from w) n_values, (select count(distinct {n}) = 1 from w) all_agree from l" for n, c in (("stage", "st"), ("sensitivity", "se"), ("speed", "sp"))))
def c10(spark, d):
    return C.consistency(records(spark, d), ["stage", "sensitivity", "speed"])


@query("c11_stage_combinations", f"with {LISTS} select array_to_string(list_transform(st, lambda x: case when x = '' then '(空)' else x end), ' + ') stages, count(*) n from l group by 1")
def c11(spark, d):
    return C.stage_combinations(records(spark, d))


@query("c11_marker_and_examiner", f"with {W}, {R} select examiner, count(distinct r.rec) n, round(avg(marker_row::int), 9) marker_share from r left join w using (rec) group by 1")
def c11_examiner(spark, d):
    return rounded(C.marker_by_examiner(records(spark, d)), 9)


def shown(rows: str, tops: dict[str, int]) -> str:
    """The most common values of each key, from rows (key, value, first) in SQL."""
    limit = "case \"key\" " + " ".join(f"when '{k}' then {n}" for k, n in tops.items()) + " end"
    return f"""g as (select "key", "value", count(*) n, min(o) o from ({rows}) group by 1, 2), h as (select *, sum(n) over (partition by "key") s, count(*) over (partition by "key") m, row_number() over (partition by "key" order by n desc, o) k from g)
    select "key", "value", n, round(n / s, 9) share, greatest(m - {limit}, 0) further from h where k <= {limit}"""


def page_rows(keys: dict[str, str]) -> str:
    return " union all ".join(f"select '{k}' \"key\", coalesce(nullif({c}::varchar, ''), '(空)') \"value\", struct_pack(a := rec, b := wave_idx) o from w" for k, c in keys.items())


def record_rows(keys: dict[str, str]) -> str:
    return " union all ".join(f"select '{k}' \"key\", coalesce(nullif({c}::varchar, ''), '(空)') \"value\", struct_pack(a := rec, b := 0) o from l where {c} is not null" for k, c in keys.items())


PAGE_KEYS = {"stage": "stage", "sensitivity": "sensitivity", "speed": "speed", "n_channels": "len(c)", "marker_row": "marker_row"}
RECORD_KEYS = {"n_pages": "len(a)", "stages": "array_to_string(list_transform(st, lambda x: case when x = '' then '(空)' else x end), ' + ')", "examiner": "examiner", "length": SEC.format(x="length")}


def distribution_query(name: str, tops: dict[str, int]):
    parts = [page_rows({k: PAGE_KEYS[k] for k in tops if k in PAGE_KEYS}), record_rows({k: RECORD_KEYS[k] for k in tops if k in RECORD_KEYS})]

    @query(name, f"with {LISTS}, {shown(' union all '.join(p for p in parts if p), tops)}")
    def run(spark, d):
        return rounded(C.distributions(records(spark, d), tops), 9)


distribution_query("c6_channels_per_page", {"n_channels": 8})
distribution_query("c9_lengths", {"length": 5})
distribution_query("c10_distributions", {"stage": 6, "sensitivity": 6, "speed": 6})
distribution_query("c11_distributions", {"marker_row": 2, "stages": 8, "examiner": 6})
distribution_query("c6_c11_distributions", C.PAGE_TOPS | C.RECORD_TOPS)


DIGITS = {"points": "n_points", "fs_len_hundredths": "round(fs_len*100)::bigint", "fs_paper_tenths": "round(fs_paper*10)::bigint", "x_step_thousandths": "round(x_step_pt*1000)::bigint"}


@query("c12_values", f"with {P} " + " union all ".join(f"select '{k}' \"key\", {c} \"value\", count(*) n from p group by 2" for k, c in DIGITS.items()))
def c12_values(spark, d):
    return C.sampling_values(pages(spark, d))


@query("c12_sampling", f"with {P} select array_to_string(list_sort(list(distinct n_points)), ' ') points, array_to_string(list_sort(list(distinct round(fs_len*100)::bigint)), ' ') fs_len_hundredths, array_to_string(list_sort(list(distinct round(fs_paper*10)::bigint)), ' ') fs_paper_tenths, array_to_string(list_sort(list(distinct round(x_step_pt*1000)::bigint)), ' ') x_step_thousandths, count(distinct n_points) = 1 and count(distinct round(x_step_pt, 3)) = 1 uniform from p")
def c12(spark, d):
    return C.sampling(pages(spark, d))


@query("c13_sensitivity_groups", f"with {P} select case when sensitivity = '' then '(空)' else sensitivity end sensitivity, count(*) n, round(arg_min(\"uV_per_pt\", struct_pack(a := rec, b := page_no)), 6) \"uV_per_pt\", round(min(y_min_step_pt), 6) y_min_step_pt, round(min(\"y_res_uV\"), 6) \"y_res_uV\" from p group by 1")
def c13(spark, d):
    return rounded(C.sensitivity_groups(pages(spark, d)))


@query("c13_spacing", f"with {P} select count(distinct round(row_spacing_pt, 2)) n_spacings, round(stddev_samp(row_spacing_pt), 6) sd, stddev_samp(row_spacing_pt) < 0.1 stable, count(*) filter (sens_missing) no_sensitivity from p")
def c13_spacing(spark, d):
    return rounded(C.spacing(pages(spark, d)))


@query("c13_std_by_sensitivity", f"with {E} select sensitivity, round(median(\"std_uV\"), 6) \"median_std_uV\" from e where montage = 'A1/A2参考' group by 1")
def c13_std(spark, d):
    return rounded(C.std_by_sensitivity(enriched(spark, d)))


FLAGS = f"{CH}, {z_sql('std_uV', True, 'a')}, f as (select *, \"std_uV\" < 1 or flat_frac > 0.5 flat, clip_frac > 0.01 saturated, coalesce(abs(z) > 5, false) outlier, (\"std_uV\" < 1 or flat_frac > 0.5) or clip_frac > 0.01 or coalesce(abs(z) > 5, false) bad from a)"


@query("c16_flags", f"with {FLAGS} select rec, page_no, ch, flat, saturated, overrange, outlier, bad from f")
def c16(spark, d):
    return C.flags(channels(spark, d)).select("rec", "page_no", "ch", "flat", "saturated", "overrange", "outlier", "bad")


@query("c16_flag_summary", f"with {FLAGS} select count(*) n, {', '.join(f'count(*) filter ({x}) {x}' for x in ('flat', 'saturated', 'outlier', 'bad', 'overrange'))}, round(avg(overrange::int), 9) overrange_share, count(distinct case when overrange then rec || '-' || page_no end) overrange_pages from f")
def c16_summary(spark, d):
    return rounded(C.flag_summary(C.flags(channels(spark, d))), 9)


@query("c17_extremes", f"with {CH}, {P}, {z_sql('zcr_hz', False, 'a')} select (select max(ptp_pt) from c) max_ptp_pt, (select count(*) from c where hf_40_49 > (select quantile_cont(hf_40_49, 0.99) from c)) above_p99, (select count(*) from a where abs(z) > 5) zcr_outliers, (select round(median(row_spacing_pt), 6) from p) row_spacing_pt")
def c17(spark, d):
    return rounded(C.extremes(channels(spark, d), pages(spark, d)))


@query("c17_top_outliers", f"with {FLAGS} select rec, page_no, ch, \"std_uV\" from f where outlier order by \"std_uV\" desc, rec, page_no, ch limit 5")
def c17_top(spark, d):
    return C.top_outliers(C.flags(channels(spark, d)))


@query("c18_bad_per_page", f"with {FLAGS} select n_bad, count(*) n_pages from (select rec, page_no, count(*) filter (bad) n_bad from f group by 1, 2) group by 1")
def c18(spark, d):
    return C.bad_per_page(C.flags(channels(spark, d)))


@query("c19_channel_ranking", f"with {CH} select ch, round(median(\"std_uV\"), 6) \"std_uV\" from c group by 1 order by 2 desc, 1 limit 8")
def c19(spark, d):
    return rounded(C.channel_ranking(channels(spark, d)))


@query("c20_precision", f"with {CH}, {P} select (select count(distinct round(y_min_step_pt, 3)) from p) n_steps, (select round(min(\"y_res_uV\"), 6) from p) res_min, (select round(max(\"y_res_uV\"), 6) from p) res_max, (select round(median(\"y_res_uV\" / sqrt(12.0)), 6) from p) \"noise_uV\", (select count(*) from c where \"std_uV\" < 5 * 0.12 * (select median(\"ptp_uV\" / greatest(ptp_pt, 1e-3)) from c)) small")
def c20(spark, d):
    return rounded(C.precision(pages(spark, d), channels(spark, d)))


DECIMALS = "select cast(l_orderkey as string) rec, l_linenumber page_no, cast(l_partkey%7 as int) decimals, count(*) n from {lineitem} group by l_orderkey, l_linenumber, l_partkey%7"


@query("c20_decimals", f"with q as ({plain(DECIMALS)}) select decimals, arg_max(n, struct_pack(a := rec, b := page_no)) last_n, sum(n)::bigint total from q group by 1 order by last_n desc, decimals limit 4")
def c20_decimals(spark, d):
    return C.decimals_merged(frame(spark, d, DECIMALS))


@query("c21_marker_transitions", f"with {P}, f as (select marker_transitions \"value\", count(*) n, min(struct_pack(a := rec, b := page_no)) o from p group by 1) select \"value\", n, round(n / (select sum(n) from f), 6) share, greatest((select count(*) from f) - 6, 0) further from f order by n desc, o limit 6")
def c21_transitions(spark, d):
    return rounded(C.marker_transitions(pages(spark, d)))


@query("c21_marker_counts", f"with {P} select count(*) filter (marker_regular) regular, count(*) filter (not marker_regular) irregular from p")
def c21(spark, d):
    return C.marker_counts(pages(spark, d))


@query("c21_extra_marks", f"with {P}, m as (select rec, page_no, stage, list_transform(list_filter(list_transform(list_filter(string_split(marker_positions, ' '), lambda x: x <> ''), lambda x: x::int), lambda x: x % 50 <> 48), lambda x: round(x / 100.0, 2)) x from p where not marker_regular) select rec, page_no, stage, len(x)::int n, coalesce(round(list_sum(x)::double, 2), 0) total from m")
def c21_marks(spark, d):
    m = C.extra_marks(pages(spark, d))
    return m.select("rec", "page_no", "stage", F.size("extra_seconds").alias("n"), F.round(F.aggregate("extra_seconds", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


REGIONS = f"{E}, g as (select rec, page_no, avg(rel_alpha) filter (ch in ('O1-A1', 'O2-A2')) alpha_rel, avg(abs_alpha) filter (ch in ('O1-A1', 'O2-A2')) alpha_abs, avg(abs_delta) filter (ch in ('FP1-A1', 'FP2-A2')) front_delta from e where montage = 'A1/A2参考' group by 1, 2)"


@query("c22_regions", f"with {REGIONS} select rec, page_no, round(alpha_rel, 6) alpha_rel, round(alpha_abs, 6) alpha_abs, round(front_delta, 6) front_delta from g")
def c22(spark, d):
    return rounded(C.regions(enriched(spark, d)))


@query("c23_alpha_pages", f"with {REGIONS}, m as (select p.rec, p.page_no, p.stage, p.montage, alpha_rel, count(*) over (partition by p.rec) n, row_number() over (partition by p.rec order by alpha_rel desc nulls last, p.page_no) k from p left join g using (rec, page_no)) select rec, page_no, stage, montage, round(alpha_rel, 6) alpha_rel, k = 1 and alpha_rel is not null best from m where n > 1")
def c23(spark, d):
    return rounded(C.alpha_pages(pages(spark, d), C.regions(enriched(spark, d))).select("rec", "page_no", "stage", "montage", "alpha_rel", "best"))


MULTI = f"{P}, n as (select *, {SEC.format(x='time_in_record')} sec0 from p qualify count(*) over (partition by rec) > 1)"


@query("c24_overlapping", f"with {MULTI} select distinct rec from (select rec, sec0 - lag(sec0) over (partition by rec, montage order by sec0) gap from n where sec0 is not null) where gap < 8")
def c24(spark, d):
    return C.overlapping(pages(spark, d))


@query("c25_repeated_starts", f"with {MULTI} select distinct rec from (select rec, sec0 from n where sec0 is not null group by 1, 2 having count(distinct montage) > 1)")
def c25(spark, d):
    return C.repeated_starts(pages(spark, d))


@query("c26_missing_starts", f"with {P}, {R} select coalesce({SEC.format(x='time_in_record')}, -1) \"value\", count(*) n from p where rec in (select rec from r where {SEC.format(x='start')} is null) group by 1 order by n desc, 1 limit 5")
def c26(spark, d):
    return C.missing_starts(frame(spark, d, RECORDS), pages(spark, d))


@query("c26_missing_counts", f"with {LISTS} select count(*) filter ({SEC.format(x='start')} is null) no_start, count(*) filter (coalesce({SEC.format(x='length')}, 0) = 0) no_length, count(*) filter (len(a) = 0) no_pages from l")
def c26_counts(spark, d):
    return C.missing_counts(records(spark, d))


START = f"{E}, st as (select rec, page_no, median(start_rms_ratio) rms, median(start_slope_ratio) slope, median(start_rms_ratio) > 2 or median(start_slope_ratio) > 3 bad from e where sec0 = 0 and montage = 'A1/A2参考' group by 1, 2)"


@query("c27_start_transients", f"with {START} select rec, page_no, round(rms, 6) rms, round(slope, 6) slope, bad from st")
def c27(spark, d):
    return rounded(C.start_transients(enriched(spark, d)))


@query("c27_transient_summary", f"with {START}, n as (select count(*) at_start, count(*) filter (bad) bad, round(count(*) / (select count(*) from p), 6) share from st), pr as ({profile_sql(['rms', 'slope'], 'st')}) select pr.*, at_start, bad, share from pr, n")
def c27_summary(spark, d):
    return rounded(C.transient_summary(C.start_transients(enriched(spark, d)), pages(spark, d)))


def stability_sql() -> str:
    page = ", ".join(f"median({h}_{b}) {h}_{b}" for b in C.HALVES for h in ("h1", "h2"))
    rank = "rank() over (order by {x}) + (count(*) over (partition by {x}) - 1) / 2.0"
    parts = [f"select '{b}' band, round(corr(x, y), 6) pearson, round(corr(rx, ry), 6) spearman, round(median(abs(x - y)), 6) difference, corr(x, y) < 0.7 unstable from (select h1_{b} x, h2_{b} y, {rank.format(x=f'h1_{b}')} rx, {rank.format(x=f'h2_{b}')} ry from g)" for b in C.HALVES]
    return f"with {E}, g as (select rec, page_no, {page} from e where montage = 'A1/A2参考' group by 1, 2) " + " union all ".join(parts)


@query("c29_half_stability", stability_sql())
def c29(spark, d):
    return rounded(C.half_stability(enriched(spark, d)))


@query("c30_eligible", f"with {P} select count(*) pages, count(distinct rec) records from p where stage = '背景' and montage = 'A1/A2参考' and not sens_missing")
def c30(spark, d):
    return C.eligible(pages(spark, d))


HISTOGRAMS = {"std_uV": True, "ptp_uV": True, "flat_frac": False, "zcr_hz": False, "hf_40_49": True, "p_hf_ratio": True}


def histogram_sql() -> str:
    parts = []
    for m, log in HISTOGRAMS.items():
        v = f"log10({m})" if log else m
        rows = f"select {v} v from c where {m} <> 0 and {m} is not null"
        parts.append(f"select '{m}' metric, b::int bin, round(lo + b * w, 6) low, count(*) n from (select least(floor((v - lo) / w), 59) b, lo, w from ({rows}), (select min(v) lo, (max(v) - min(v)) / 60 w from ({rows}))) group by 1, 2, 3")
    return f"with {CH} " + " union all ".join(parts)


@query("c31_histograms", histogram_sql())
def c31(spark, d):
    return rounded(stats.histograms(channels(spark, d), HISTOGRAMS))


@query("t19_other_texts", f"with t as ({plain(TEXTS)}) select text, count(*) n, count(distinct rec) records from t where not contains(text, '滤波') group by 1")
def t19_texts(spark, d):
    return C.other_texts(frame(spark, d, TEXTS))


@query("t19_matching_texts", f"with t as ({plain(TEXTS)}) select text, count(*) n, count(distinct rec) records from t where regexp_matches(text, '滤波|陷波|采样|Hz') group by 1")
def t19_matching(spark, d):
    return C.matching_texts(frame(spark, d, TEXTS))
