"""Exact statistics over columns: NaN counts as missing.

Quantiles, medians, robust deviations and ranks run passes over their rows when they are called, and write what they count
to the shared folder (see ``lineage``); the plans they return start from these tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceqc.functions.lineage import cut

QUANTILES = (0.01, 0.05, 0.5, 0.95, 0.99)


def known(c: Column | str) -> Column:
    """The value, null where it is NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c.cast("double"), F.lit(float("nan")))


def frequencies(df: DataFrame, value: Column, order: Column, total: Column | None = None, top: int = 8) -> DataFrame:
    """The most common values with their share of ``total`` (default: all rows) and the number of further values; ties in
    order of first appearance by ``order``. Rows are pre-aggregated; only distinct values are counted against the total.
    """
    counted = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    sums = counted.agg(F.sum("n").alias("_all"), F.count("*").alias("_values"))  # one row
    best = counted.orderBy(F.desc("n"), "_first").limit(top)
    share = F.col("n") / (F.col("_all") if total is None else total)
    return best.crossJoin(F.broadcast(sums)).select("value", "n", share.alias("share"), F.greatest(F.col("_values") - top, F.lit(0)).alias("further"))


EMPTY = "(空)"


def counted(rows: DataFrame, values: Column, order: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """(key, value, n, _first) over all keys in one aggregate of one scan. ``values`` is an array of structs (key, value) for
    each row, ``order`` says which row is first; ``extra`` are further sums of numbers for each row and key."""
    extra = extra or {}
    flat = rows.select(order.alias("_order"), *(c.alias(n) for n, c in extra.items()), F.posexplode(values).alias("_at", "_v"))
    key = flat.groupBy(F.col("_v.key").alias("key"), F.col("_v.value").alias("value"))
    return key.agg(F.count("*").alias("n"), F.min(F.struct("_order", "_at")).alias("_first"), *(F.sum(n).alias(n) for n in extra))


def entries(values: dict[str, Column]) -> Column:
    """Arrays of texts by key as one array of (key, value); null values are left out, empty ones are ``EMPTY``."""
    pair = lambda k: lambda v: F.struct(F.lit(k).alias("key"), F.when(v == "", EMPTY).otherwise(v).alias("value"))
    return F.flatten(F.array(*(F.transform(F.filter(a, lambda v: v.isNotNull()), pair(k)) for k, a in values.items())))


def most_common(counts: DataFrame, tops: dict[str, int]) -> DataFrame:
    """Of counts by (key, value) the ``tops[key]`` most common of each key with their share of all, and the number of further
    values; ties in order of first appearance.

    Values and totals come from one aggregate (grouping sets). Ranks are limited in each task before rows of a key meet.
    """
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in tops.items() for x in pair)), F.col("key"))
    both = counts.groupingSets([["key", "value"], ["key"]], "key", "value").agg(F.sum("n").alias("n"), F.min("_first").alias("_first"), F.count("*").alias("_values"), F.grouping("value").alias("_total"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_total"), F.desc("n"), "_first"))
    best = both.withColumn("_rank", rank).where(F.col("_rank") <= max(tops.values()) + 1).where(F.col("_rank") <= limit + 1)
    total = lambda c: F.max(F.when(F.col("_total") == 1, F.col(c))).over(Window.partitionBy("key"))
    out = best.withColumns({"_all": total("n"), "_values": total("_values")}).where("_total = 0")
    return out.select("key", "value", "n", (F.col("n") / F.col("_all")).alias("share"), F.greatest(F.col("_values") - limit, F.lit(0)).alias("further"))


def unpivot(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, value) for each row and metric; missing values left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), known(m).alias("value")) for m in metrics)))
    return df.select(pairs.alias("_p")).select("_p.*").where("value is not null")


#: Bins in each power of two.
BINS = 1 << 16


def placed(v: str) -> Column:
    """The bin of a double, in the order of doubles: its power of two and the next sixteen bits."""
    power = f"if({v} = 0, -1100, floor(log2(abs({v}))))"
    inner = f"transform(array({power}), p -> (p + 1101) * {BINS} + if({v} = 0, 0, floor((abs({v}) / pow(2, p) - 1) * {BINS})))[0]"
    return F.expr(f"cast(signum({v}) * if(abs({v}) = double('inf'), {BINS} * 3000, {inner}) as long)")


def among(rows: DataFrame, few: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """Rows whose keys are in ``few`` (null is equal to null), with its columns ``more``."""
    right = few.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *more)
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(right, on).drop(*(f"_of_{k}" for k in keys))


def value_counts(rows: DataFrame, group: list[str], value: Column | str) -> DataFrame:
    """The values ``_v`` of each group with their counts ``_n``, as a table; missing values are left out."""
    return cut(rows.select(*group, known(value).alias("_v")).where("_v is not null").groupBy(*group, "_v").agg(F.count("*").alias("_n")))


def binned(counts: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Values with their bin, and for each bin the rows ``_from`` below it in its group, those in it and ``_all`` of the group."""
    of = Window.partitionBy(*group)
    slim = counts.withColumn("_bin", placed("_v"))
    bins = slim.groupBy(*group, "_bin").agg(F.sum("_n").alias("_n"))
    return slim, bins.withColumns({"_all": F.sum("_n").over(of), "_from": F.sum("_n").over(of.orderBy("_bin")) - F.col("_n")})


def below(group: list[str]) -> Column:
    """Rows of the same bin with smaller values."""
    inside = Window.partitionBy(*group, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_n").over(inside), F.lit(0))


def selected(counts: DataFrame, group: list[str], probs: tuple, names: list[str]) -> DataFrame:
    """Exact interpolated quantiles of each group, with its number of values ``n``, from values with counts.

    Selection by refinement: the bins of all groups are counted in one aggregate, and only the values of bins that hold a
    wanted rank are sorted. What comes together in one task are the bins of a group, or the distinct values of one bin,
    which agree in 28 leading bits. Null groups are one group.
    """
    one = [*group, "_bin"]
    wanted = F.expr(f"transform(array({', '.join(f'double({p})' for p in probs)}), p -> (_all - 1) * p)")
    held = F.expr("exists(_at, r -> _from <= ceil(r) and floor(r) < _from + _n)")
    slim, bins = binned(counts, group)
    few = bins.withColumn("_at", wanted).where(held).select(*one, F.col("_from").alias("_base"), "_at", "_all")
    found = among(slim, few, one, ["_base", "_at", "_all"]).withColumn("_from", F.col("_base") + below(group))
    end = lambda f, k: F.expr(f"max(if(_from <= {f}(_at[{k}]) and {f}(_at[{k}]) < _from + _n, _v, null))")
    ends = [end(f, k).alias(f"_{f}{k}") for k in range(len(probs)) for f in ("floor", "ceil")]
    out = found.groupBy(*group).agg(F.first("_all").alias("n"), F.first("_at").alias("_at"), *ends).where("n is not null")
    between = lambda k: f"if(ceil(_at[{k}]) = floor(_at[{k}]), _floor{k}, (ceil(_at[{k}]) - _at[{k}]) * _floor{k} + (_at[{k}] - floor(_at[{k}])) * _ceil{k})"
    return out.select(*group, "n", *(F.expr(between(k)).alias(name) for k, name in enumerate(names)))


def quantiles(rows: DataFrame, group: list[str], value: Column | str, probs: tuple, names: list[str]) -> DataFrame:
    """Exact interpolated quantiles of ``value`` in each group, with its number of values ``n``. The rows are read once, when
    this is called: their distinct values are counted into a table, which ``selected`` reads."""
    return selected(value_counts(rows, group, value), group, probs, names)


def medians(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """The exact median of each group."""
    return quantiles(rows, group, value, (0.5,), [name]).drop("n")


def profile(df: DataFrame, metrics: list[str], approx: bool = False) -> DataFrame:
    """Quantiles, minimum and maximum of each metric; ``approx`` for sketches in one pass."""
    rows = unpivot(df, metrics)
    names = [f"p{round(100 * p)}" for p in QUANTILES]
    if approx:
        q = F.percentile_approx("value", list(QUANTILES), 10_000)
        out = rows.groupBy("metric").agg(F.count("*").alias("n"), q.alias("_q"), F.min("value").alias("min"), F.max("value").alias("max"))
        return out.select("metric", "n", *(F.get("_q", F.lit(k)).alias(name) for k, name in enumerate(names)), "min", "max")
    out = quantiles(rows, ["metric"], "value", (*QUANTILES, 0.0, 1.0), [*names, "min", "max"])
    return out.select("metric", "n", *names, "min", "max")


def robust_z(df: DataFrame, metric: str, group: str = "ch", log: bool = False, name: str = "z") -> DataFrame:
    """Adds the distance from the group's median in units of its scaled median absolute deviation.

    Two passes: one counts the values of each group, from which both medians follow; one adds the distances. The medians
    are a table of a row a group, which the planner broadcasts when it is small.
    """
    value = F.when(known(metric).isNotNull(), F.log10(F.greatest(known(metric), F.lit(1e-6)))) if log else known(metric)
    counts = value_counts(df, [group], value)
    middle = cut(selected(counts, [group], (0.5,), ["_m"]).drop("n"))
    away = counts.join(middle, group).withColumn("_v", F.abs(F.col("_v") - F.col("_m")))
    both = cut(selected(away, [group], (0.5,), ["_s"]).drop("n").join(middle, group))
    return df.withColumn("_v", value).join(both, group).withColumn(name, (F.col("_v") - F.col("_m")) / (1.4826 * F.col("_s") + 1e-12)).drop("_v", "_m", "_s")


def histograms(df: DataFrame, metrics: dict[str, bool], bins: int = 60) -> DataFrame:
    """(metric, bin, low, n) for all metrics: equal bins from minimum to maximum, the last one closed; zeros and missing values
    dropped; of those marked true the decimal logarithm.

    Two scans whatever the number of metrics: one for the spans (a row a metric), one for the counts.
    """
    pair = lambda m, log: F.struct(F.lit(m).alias("metric"), F.when(known(m) != 0, F.log10(known(m)) if log else known(m)).alias("v"))
    rows = df.select(F.explode(F.array(*(pair(m, log) for m, log in metrics.items()))).alias("_p")).select("_p.*").where("v is not null")
    span = rows.groupBy("metric").agg(F.min("v").alias("lo"), ((F.max("v") - F.min("v")) / bins).alias("_w"))  # a row a metric
    place = F.when(F.col("_w") > 0, F.least(F.floor((F.col("v") - F.col("lo")) / F.col("_w")), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counted_ = rows.join(F.broadcast(span), "metric").groupBy("metric", place.alias("bin"), "lo", "_w").agg(F.count("*").alias("n"))
    return counted_.select("metric", "bin", (F.col("lo") + F.col("bin") * F.col("_w")).alias("low"), "n")


def ranks(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """(group, value, name): the average rank of each distinct ``value`` within its group, without bringing a group into
    one task: the rows in bins below its own, those below it in its bin, and half of its ties. The rows are read once, when
    this is called."""
    slim, bins = binned(value_counts(rows, group, value), group)
    placed_ = among(slim, bins.withColumnRenamed("_from", "_base"), [*group, "_bin"], ["_base"])
    return placed_.select(*group, F.col("_v").alias(value), (F.col("_base") + below(group) + (F.col("_n") + 1) / 2).alias(name))


def average_rank(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Adds the average rank of ``value`` within ``group``; ties share theirs, a missing value has none."""
    return df.join(ranks(df, [group], value, name), [group, value], "left")
