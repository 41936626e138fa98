"""Summaries of a cohort: waveform lists, page and channel quality, states, and eligibility.

Pages have rec, page_no, wave_idx; channels have rec, page_no, ch. Waveforms are flat: one row for each page of a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceqc.functions import stats
from traceqc.functions.lineage import cut
from traceqc.functions.text import FILTER_WORDS, seconds

REFERENCE, REF, BIPOLAR = "A1/A2参考", "REF", "双极"
RESTING = "背景"
PAGE = ["rec", "page_no"]
HALVES = ("delta", "theta", "alpha", "beta")


def montage(channels: Column) -> Column:
    """Class of a page by its first channel (an array of names); pages without any are bipolar."""
    first = F.get(channels, F.lit(0))
    return F.when(first.endswith("A1"), REFERENCE).when(first.contains("REF"), REF).otherwise(BIPOLAR)


def with_montage(pages: DataFrame, waves: DataFrame) -> DataFrame:
    """Pages with the montage of the waveform entry at their running index; null without one."""
    own = pages.drop("montage").withColumn("_k", F.row_number().over(Window.partitionBy("rec").orderBy("page_no")))
    entry = waves.select("rec", F.row_number().over(Window.partitionBy("rec").orderBy("wave_idx")).alias("_k"), montage(F.col("channels")).alias("montage"))
    return own.join(entry, ["rec", "_k"], "left").drop("_k")


def enriched(channels: DataFrame, pages: DataFrame) -> DataFrame:
    """Channels with state, sensitivity, montage and start second of their page."""
    return channels.join(pages.select(*PAGE, "stage", "sensitivity", "montage", seconds(F.col("time_in_record")).alias("sec0")), PAGE)


# --- waveform lists


def pages_per_record(records: DataFrame) -> DataFrame:
    return records.groupBy(F.size("waveforms").alias("n_pages")).agg(F.count("*").alias("n_records"))


def channel_shares(waves: DataFrame, records: DataFrame) -> DataFrame:
    """In how many records a channel occurs, and their share of all records."""
    pairs = waves.select("rec", F.explode("channels").alias("ch")).distinct()
    total = records.agg(F.count("*").alias("_all"))  # one row
    return pairs.groupBy("ch").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("ch", "n", (F.col("n") / F.col("_all")).alias("share"))


def tuples(waves: DataFrame, top: int = 5) -> DataFrame:
    """The most common lists of channels with count, share and kind; ties in alphabetical order."""
    name = F.array_join("channels", ",")
    kind = F.when(F.exists("channels", lambda c: c.endswith("A1") | c.endswith("A2")), REFERENCE).when(F.size("channels") > 0, BIPOLAR).otherwise("")
    rows = waves.groupBy(name.alias("channels")).agg(F.count("*").alias("n"), F.first(kind).alias("kind"))
    total = rows.agg(F.sum("n").alias("_all"))  # one row
    return rows.orderBy(F.desc("n"), "channels").limit(top).crossJoin(F.broadcast(total)).select("channels", "kind", "n", (F.col("n") / F.col("_all")).alias("share"))


def sequences(records: DataFrame) -> DataFrame:
    """One row for each sequence of channel lists over the pages of a record: how many records have it, and how many
    distinct channels each page has."""
    key = F.transform("waveforms", lambda w: F.array_join(w["channels"], ","))
    sizes = F.array_join(F.transform("waveforms", lambda w: F.size(F.array_distinct(w["channels"])).cast("string")), " | ")
    out = records.groupBy(key.alias("_pages")).agg(F.count("*").alias("n"), F.first(sizes).alias("sizes"))
    return out.select(F.array_join("_pages", " | ").alias("pages"), "n", "sizes")


def merged_sets(records: DataFrame) -> DataFrame:
    """One row for each set of channels that the pages of a record have together."""
    own = F.array_sort(F.array_distinct(F.flatten(F.transform("waveforms", lambda w: w["channels"]))))
    return records.groupBy(F.array_join(own, ",").alias("channels")).agg(F.count("*").alias("n"))


def second_summary(df: DataFrame, text: str) -> DataFrame:
    """Seconds read from a text: how many, mean, median, smallest and largest."""
    s = seconds(F.col(text))
    return df.agg(F.count("*").alias("total"), F.count(s).alias("n"), F.avg(s).alias("mean"), F.median(s).alias("median"), F.min(s).alias("min"), F.max(s).alias("max"))


#: What is counted over pages and over records, and how many values of each are shown.
PAGE_TOPS = {"stage": 6, "sensitivity": 6, "speed": 6, "n_channels": 8, "marker_row": 2}
RECORD_TOPS = {"n_pages": 8, "stages": 8, "examiner": 6, "length": 5}


def page_values(keys: tuple[str, ...] = tuple(PAGE_TOPS)) -> dict[str, Column]:
    """For each key its values over the pages of a record, as texts."""

    def of(key: str) -> Column:
        return F.transform("waveforms", lambda w: F.size(w["channels"]).cast("string") if key == "n_channels" else w[key].cast("string"))

    return {k: of(k) for k in keys}


def record_values(keys: tuple[str, ...] = tuple(RECORD_TOPS)) -> dict[str, Column]:
    """For each key the value of a record, as an array of one text."""
    shown = F.transform("waveforms", lambda w: F.when(w["stage"] == "", F.lit(stats.EMPTY)).otherwise(w["stage"]))
    own = {"n_pages": F.size("waveforms").cast("string"), "stages": F.array_join(shown, " + "), "length": seconds(F.col("length")).cast("string")}
    return {k: F.array(own.get(k, F.col(k))) for k in keys}


def distributions(records: DataFrame, tops: dict[str, int] | None = None) -> DataFrame:
    """(key, value, n, share, further): how often pages (stage, sensitivity, speed, number of channels, marker row) and records
    (number of pages, combination of stages, examiner, length in seconds) have a value; ``tops`` names the keys and how
    many values of each are shown. Empty texts are shown as such, missing lengths are left out; ties in order of records.

    All keys are counted in one aggregate over one scan of the records.
    """
    tops = PAGE_TOPS | RECORD_TOPS if tops is None else tops
    values = page_values(tuple(k for k in tops if k in PAGE_TOPS)) | record_values(tuple(k for k in tops if k not in PAGE_TOPS))
    return stats.most_common(stats.counted(records, stats.entries(values), F.col("rec")), tops)


def consistency(records: DataFrame, keys: list[str]) -> DataFrame:
    """For each key of the waveform entries: records with at most one value, distinct values over all pages, and whether
    all pages agree. One scan; what is counted is one row for each key and distinct value of a record."""
    each = F.array(*(F.struct(F.lit(k).alias("key"), F.array_distinct(v).alias("values")) for k, v in page_values(tuple(keys)).items()))
    rows = records.select(F.explode(each).alias("_k")).select("_k.key", F.size("_k.values").alias("_size"), F.posexplode_outer("_k.values").alias("_at", "value"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0  # a record without pages has one row too
    values = rows.groupBy("key", "value").agg(F.count_if(first).alias("records"), F.count_if(first & (F.col("_size") <= 1)).alias("consistent"))
    out = values.groupBy("key").agg(F.sum("consistent").alias("consistent"), F.sum("records").alias("records"), F.count("value").alias("n_values"))
    return out.withColumn("all_agree", F.col("n_values") == 1)


def stage_combinations(records: DataFrame) -> DataFrame:
    return records.groupBy(record_values(("stages",))["stages"][0].alias("stages")).agg(F.count("*").alias("n"))


def marker_by_examiner(records: DataFrame) -> DataFrame:
    """Records of each examiner, and the share of their pages that have a marker row."""
    pages = F.size(F.filter("waveforms", lambda w: w["marker_row"].isNotNull()))
    marked = F.size(F.filter("waveforms", lambda w: w["marker_row"]))
    return records.groupBy("examiner").agg(F.count("*").alias("n"), (F.sum(marked) / F.nullif(F.sum(pages), F.lit(0))).alias("marker_share"))


# --- texts on pages


def texts(rows: DataFrame) -> DataFrame:
    """(text, n, records): how often each text stands on pages, and in how many records. Rows are pre-aggregated by record."""
    return rows.groupBy("text", "rec").agg(F.count("*").alias("n")).groupBy("text").agg(F.sum("n").alias("n"), F.count("rec").alias("records"))


def matching_texts(rows: DataFrame, pattern: str = FILTER_WORDS) -> DataFrame:
    """The texts that match ``pattern`` (by default, words of filters and sampling)."""
    return texts(rows.where(F.col("text").rlike(pattern)))


def other_texts(rows: DataFrame, word: str = "滤波") -> DataFrame:
    """The texts without ``word``; missing ones are left out."""
    return texts(rows.where(~F.col("text").contains(word)))


def text_search(rows: DataFrame, pattern: str = FILTER_WORDS, word: str = "滤波") -> DataFrame:
    """One row: rows that match, their records and distinct texts in order, and rows without ``word``; two aggregates, of which
    the first leaves a row for each text and record."""
    hit = F.col("text").rlike(pattern)
    slim = rows.groupBy(F.when(hit, F.col("text")).alias("text"), F.when(hit, F.col("rec")).alias("rec")).agg(F.count("*").alias("n"), F.count_if(~F.col("text").contains(word)).alias("others"))
    return slim.agg(
        F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.col("n"))), F.lit(0)).alias("hits"),
        F.countDistinct("rec").alias("records"),
        F.array_join(F.array_sort(F.collect_set("text")), "|").alias("texts"),
        F.coalesce(F.sum("others"), F.lit(0)).alias("others"),
    )


# --- page and channel quality


def sampling_values(pages: DataFrame) -> DataFrame:
    """(key, value, n): pages by number of points, and by rates and step in their last shown digit; one scan."""
    digit = {"points": F.col("n_points"), "fs_len_hundredths": F.round(F.col("fs_len") * 100), "fs_paper_tenths": F.round(F.col("fs_paper") * 10), "x_step_thousandths": F.round(F.col("x_step_pt") * 1000)}
    values = F.array(*(F.struct(F.lit(k).alias("key"), c.cast("long").alias("value")) for k, c in digit.items()))
    return pages.select(F.explode(values).alias("_v")).groupBy("_v.key", "_v.value").agg(F.count("*").alias("n")).where("value is not null")


def sampling(pages: DataFrame) -> DataFrame:
    """Distinct numbers of points, rates and steps, and whether all pages are sampled alike; from the counts of values."""
    of = lambda key: F.when(F.col("key") == key, F.col("value"))
    text = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(of(key))), lambda x: x.cast("string")), " ")
    uniform = (F.count(of("points")) == 1) & (F.count(of("x_step_thousandths")) == 1)
    return sampling_values(pages).agg(*(text(k).alias(k) for k in ("points", "fs_len_hundredths", "fs_paper_tenths", "x_step_thousandths")), uniform.alias("uniform"))


def sensitivity_groups(pages: DataFrame) -> DataFrame:
    """For each sensitivity: pages, calibration of the first page, smallest step and resolution."""
    label = F.when(F.coalesce("sensitivity", F.lit("")) == "", F.lit("(空)")).otherwise(F.col("sensitivity"))
    return pages.groupBy(label.alias("sensitivity")).agg(
        F.count("*").alias("n"), F.min_by("uV_per_pt", F.struct(*PAGE)).alias("uV_per_pt"), F.min("y_min_step_pt").alias("y_min_step_pt"), F.min("y_res_uV").alias("y_res_uV")
    )


def spacing(pages: DataFrame, limit: float = 0.1) -> DataFrame:
    """Distinct row spacings, their spread, whether it is small, and pages without sensitivity."""
    return pages.agg(F.countDistinct(F.round("row_spacing_pt", 2)).alias("n_spacings"), F.stddev_samp("row_spacing_pt").alias("sd"), (F.stddev_samp("row_spacing_pt") < limit).alias("stable"), F.count_if("sens_missing").alias("no_sensitivity"))


def std_by_sensitivity(enriched_channels: DataFrame) -> DataFrame:
    return stats.medians(enriched_channels.where(F.col("montage") == REFERENCE), ["sensitivity"], "std_uV", "median_std_uV")


def outlier_counts(channels: DataFrame, metric: str, k: float, log: bool) -> DataFrame:
    """Channel rows and distinct pages beyond ``k`` robust deviations."""
    out = stats.robust_z(channels.select(*PAGE, "ch", metric), metric, log=log).where(F.abs("z") > k)
    return out.agg(F.lit(metric).alias("metric"), F.count("*").alias("rows"), F.countDistinct(F.struct(*PAGE)).alias("pages"))


def spectral_shape(channels: DataFrame) -> DataFrame:
    """One row: median and 99th percentile of the high frequencies, and the median ratio."""
    high = stats.quantiles(channels.select("hf_40_49"), [], "hf_40_49", (0.5, 0.99), ["hf_median", "hf_p99"]).drop("n")
    return high.crossJoin(stats.medians(channels.select("p_hf_ratio"), [], "p_hf_ratio", "ratio_median"))


def flags(channels: DataFrame) -> DataFrame:
    """Channels with the flags flat, saturated, overrange, outlier and bad (flat, saturated or outlier)."""
    out = stats.robust_z(channels, "std_uV", log=True).withColumns({"flat": (F.col("std_uV") < 1) | (F.col("flat_frac") > 0.5), "saturated": F.col("clip_frac") > 0.01, "outlier": F.coalesce(F.abs("z") > 5, F.lit(False))})
    return out.withColumn("bad", F.col("flat") | F.col("saturated") | F.col("outlier"))


def flag_summary(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("flat", "saturated", "outlier", "bad", "overrange")), F.avg(F.col("overrange").cast("int")).alias("overrange_share"), F.countDistinct(F.when(F.col("overrange"), F.struct(*PAGE))).alias("overrange_pages")
    )


def bad_per_page(flagged: DataFrame) -> DataFrame:
    """How many pages have how many bad channels."""
    page = flagged.groupBy(*PAGE).agg(F.count_if("bad").alias("n_bad"))
    return page.groupBy("n_bad").agg(F.count("*").alias("n_pages"))


def extremes(channels: DataFrame, pages: DataFrame) -> DataFrame:
    """Largest amplitude, median row spacing, zero-crossing outliers, and rows above the 99th percentile of high
    frequencies. Every part is one row."""
    high = stats.quantiles(channels.select("hf_40_49"), [], "hf_40_49", (0.99,), ["_p99"]).drop("n")
    top = channels.agg(F.max("ptp_pt").alias("max_ptp_pt")).crossJoin(F.broadcast(high))
    above = channels.crossJoin(F.broadcast(top)).agg(F.first("max_ptp_pt").alias("max_ptp_pt"), F.count_if(F.col("hf_40_49") > F.col("_p99")).alias("above_p99"))
    odd = stats.robust_z(channels, "zcr_hz").where(F.abs("z") > 5).agg(F.count("*").alias("zcr_outliers"))
    return above.crossJoin(odd).crossJoin(stats.medians(pages.select("row_spacing_pt"), [], "row_spacing_pt", "row_spacing_pt_").withColumnRenamed("row_spacing_pt_", "row_spacing_pt"))


def top_outliers(flagged: DataFrame, n: int = 5) -> DataFrame:
    return flagged.where("outlier").orderBy(F.desc("std_uV"), *PAGE, "ch").limit(n).select(*PAGE, "ch", "std_uV")


def channel_ranking(channels: DataFrame, n: int = 8) -> DataFrame:
    return stats.medians(channels, ["ch"], "std_uV", "_median").withColumnRenamed("_median", "std_uV").orderBy(F.desc("std_uV"), "ch").limit(n)


def precision(pages: DataFrame, channels: DataFrame) -> DataFrame:
    """Steps, resolution, quantisation noise, and channels too small for the resolution."""
    p = pages.agg(F.countDistinct(F.round("y_min_step_pt", 3)).alias("n_steps"), F.min("y_res_uV").alias("res_min"), F.max("y_res_uV").alias("res_max"))
    noise = stats.medians(pages.select((F.col("y_res_uV") / F.sqrt(F.lit(12.0))).alias("v")), [], "v", "noise_uV")
    scale = stats.medians(channels.select((F.col("ptp_uV") / F.greatest("ptp_pt", F.lit(1e-3))).alias("v")), [], "v", "_scale")  # one row
    small = channels.crossJoin(F.broadcast(scale)).agg(F.count_if(F.col("std_uV") < 5 * 0.12 * F.col("_scale")).alias("small"))
    return p.crossJoin(noise).crossJoin(small)


def decimals_merged(counts: DataFrame, top: int = 4) -> DataFrame:
    """Decimals over all pages: the count of the last page that has them (as the original report has it), and the sum."""
    return counts.groupBy("decimals").agg(F.max_by("n", F.struct(*PAGE)).alias("last_n"), F.sum("n").alias("total")).orderBy(F.desc("last_n"), "decimals").limit(top)


# --- states


def marker_transitions(pages: DataFrame, top: int = 6) -> DataFrame:
    """The most common numbers of transitions of the marker row, with their pages and share."""
    return stats.frequencies(pages, F.col("marker_transitions"), F.struct(*PAGE), top=top)


def marker_counts(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count_if("marker_regular").alias("regular"), F.count_if(~F.col("marker_regular")).alias("irregular"))


def extra_marks(pages: DataFrame, period: int = 50, phase: int = 48, rate: float = 100.0) -> DataFrame:
    """Positions (seconds) of transitions outside the time scale, for pages with irregular markers."""
    at = F.transform(F.filter(F.split("marker_positions", " "), lambda x: x != ""), lambda x: x.cast("int"))
    return pages.where(~F.col("marker_regular")).select(*PAGE, "stage", F.transform(F.filter(at, lambda x: x % period != phase), lambda x: F.round(x / rate, 2)).alias("extra_seconds"))


def regions(enriched_channels: DataFrame) -> DataFrame:
    """Means over the occipital and frontal channels of each page of the reference montage."""
    at = lambda names, c: F.avg(F.when(F.col("ch").isin(*names), stats.known(c)))
    back, front = ("O1-A1", "O2-A2"), ("FP1-A1", "FP2-A2")
    return enriched_channels.where(F.col("montage") == REFERENCE).groupBy(*PAGE).agg(at(back, "rel_alpha").alias("alpha_rel"), at(back, "abs_alpha").alias("alpha_abs"), at(front, "abs_delta").alias("front_delta"))


def multi_page(pages: DataFrame) -> DataFrame:
    """Pages of records that have more than one."""
    return pages.withColumn("_n", F.count("*").over(Window.partitionBy("rec"))).where("_n > 1").drop("_n")


def alpha_pages(pages: DataFrame, region_rows: DataFrame) -> DataFrame:
    """Pages of records with several, and which of them has the highest occipital alpha (the first on ties)."""
    rows = multi_page(pages).join(region_rows, PAGE, "left")
    best = F.row_number().over(Window.partitionBy("rec").orderBy(F.col("alpha_rel").desc_nulls_last(), "page_no"))
    return rows.withColumn("best", (best == 1) & F.col("alpha_rel").isNotNull())


def overlapping(pages: DataFrame, length: float = 8) -> DataFrame:
    """Records with two pages of one montage that start less than ``length`` seconds apart."""
    rows = multi_page(pages).where("montage is not null").withColumn("sec0", seconds(F.col("time_in_record"))).where("sec0 is not null")
    gap = F.col("sec0") - F.lag("sec0").over(Window.partitionBy("rec", "montage").orderBy("sec0"))
    return rows.withColumn("_gap", gap).where(F.col("_gap") < length).select("rec").distinct()


def repeated_starts(pages: DataFrame) -> DataFrame:
    """Records that show one start second in several montages."""
    rows = multi_page(pages).withColumn("sec0", seconds(F.col("time_in_record"))).where("sec0 is not null")
    return rows.groupBy("rec", "sec0").agg(F.countDistinct("montage").alias("n")).where("n > 1").select("rec").distinct()


def missing_starts(records: DataFrame, pages: DataFrame, top: int = 5) -> DataFrame:
    """(value, n): start seconds of the pages of records without a start, -1 for none; the most common ones."""
    open_ = records.where(seconds(F.col("start")).isNull()).select("rec")
    value = F.coalesce(seconds(F.col("time_in_record")), F.lit(-1))
    return pages.join(open_, "rec", "left_semi").groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def missing_counts(records: DataFrame) -> DataFrame:
    length = seconds(F.col("length"))
    return records.agg(F.count_if(seconds(F.col("start")).isNull()).alias("no_start"), F.count_if(F.coalesce(length, F.lit(0)) == 0).alias("no_length"), F.count_if(F.size("waveforms") == 0).alias("no_pages"))


def start_transients(enriched_channels: DataFrame) -> DataFrame:
    """Pages of the reference montage at second 0: medians of the start ratios over channels, and whether they are bad."""
    rows = enriched_channels.where((F.col("sec0") == 0) & (F.col("montage") == REFERENCE))
    out = rows.groupBy(*PAGE).agg(F.median("start_rms_ratio").alias("rms"), F.median("start_slope_ratio").alias("slope"))
    return out.withColumn("bad", (F.col("rms") > 2) | (F.col("slope") > 3))


def transient_summary(transients: DataFrame, pages: DataFrame) -> DataFrame:
    """For both start ratios, the profile over the pages at second 0; with these pages, their share of all pages, and the
    bad ones among them."""
    counts = transients.agg(F.count("*").alias("at_start"), F.count_if("bad").alias("bad"))  # one row
    counts = counts.crossJoin(pages.agg(F.count("*").alias("_pages"))).withColumn("share", F.col("at_start") / F.col("_pages")).drop("_pages")
    return stats.profile(transients, ["rms", "slope"]).crossJoin(F.broadcast(counts))


def half_stability(enriched_channels: DataFrame) -> DataFrame:
    """For each band: correlations over pages of the medians of both halves, and their median difference."""
    names = [f"{h}_{b}" for b in HALVES for h in ("h1", "h2")]
    page = enriched_channels.where(F.col("montage") == REFERENCE).groupBy(*PAGE).agg(*(F.median(c).alias(c) for c in names))
    bands = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(f"h1_{b}").alias("x"), F.col(f"h2_{b}").alias("y")) for b in HALVES)))
    rows = cut(page.select(bands.alias("_b")).select("_b.*").where("x is not null and y is not null"))
    sides = F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in ("x", "y"))))
    rank = stats.ranks(rows.select("band", sides.alias("_s")).select("band", "_s.*"), ["band", "side"], "v", "r")
    ranked = rows
    for c in ("x", "y"):
        ranked = ranked.join(rank.where(F.col("side") == c).select("band", F.col("v").alias(c), F.col("r").alias(f"r{c}")), ["band", c])
    out = ranked.groupBy("band").agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))
    out = out.join(stats.medians(rows.select("band", F.abs(F.col("x") - F.col("y")).alias("d")), ["band"], "d", "difference"), "band")
    return out.withColumn("unstable", F.col("pearson") < 0.7)


def eligible(pages: DataFrame) -> DataFrame:
    """Pages of the resting state in the reference montage with a sensitivity: pages and records."""
    return pages.where((F.col("stage") == RESTING) & (F.col("montage") == REFERENCE) & ~F.col("sens_missing")).agg(F.count("*").alias("pages"), F.countDistinct("rec").alias("records"))
