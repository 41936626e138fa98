"""Quality rules with host-level verdicts.

Each document is measured by built-in functions only. Rule failures are summed by domain (here: ``source``), the
failure rates are shrunk towards an empirical beta prior fitted over all domains, and the verdict of a domain
comes back to its documents by a join of slim rows (never of texts), which adaptive execution can split where one
domain holds a third of them.

Defined results: a null text has no words, lines or symbols and fails the base rules; null domains are one domain of
their own; repeated rows are measured one by one; a rate that equals a limit is within it; texts are measured whole,
whatever their length; an empty table gives an empty result; further columns, of whatever names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceqc.llm.common import cut, let, table, words_of

SYMBOLS = "[#*$%&|<>]"
#: More than the words of any text: a longer one has no room in an array of strings.
PLACES = 1 << 28


@dataclass(frozen=True)
class Rules:
    """Base limits, limits of the further rules, and what makes a domain bad or good."""

    min_words: int = 10
    max_repeat_pct: int = 20
    window: int = 5
    max_symbol_pct: int = 10  # of words
    max_dup_line_pct: int = 30  # of lines with a word
    max_mean_word: int = 20  # characters
    reject_rate: float = 0.5  # shrunk failure rate above which a whole domain goes
    good_share: float = 0.5  # share of the prior's mean below which a domain may keep documents with one failure


def windows(h: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` of the hashes ``h`` (as many at least)."""
    return F.transform(F.slice(h, F.lit(1), F.size(h) - (width - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, width))))


def repeated_words(words: Column, width: int) -> Column:
    """Words that stand in a window of ``width`` words found twice or more in the same text.

    Words are hashed once, and windows from these hashes. Where two windows are equal, numbers made of the upper bits of
    a hash and of the place are sorted; those whose upper bits have an equal neighbour are compared in full: n log n
    for a text of n words.
    """

    def covered(at: Column) -> Column:
        step = lambda k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - F.get(at, k), F.lit(width)))
        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0), lambda total, k: total + step(k))

    def twice(pairs: Column, same) -> Column:
        """Of sorted ``pairs``, those that are the ``same`` as a neighbour."""
        near = lambda x, y: F.coalesce(same(x, y), F.lit(False))
        return F.filter(pairs, lambda x, k: near(x, F.get(pairs, k + 1)) | near(x, F.get(pairs, k - 1)))

    def found(w: Column) -> Column:
        low, high = (F.lit(m).cast("long") for m in (PLACES - 1, -PLACES))
        packed = F.sort_array(F.transform(w, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long"))))
        close = let(packed, lambda s: twice(s, lambda x, y: x.bitwiseXOR(y).bitwiseAND(high) == 0))
        full = F.sort_array(F.transform(F.transform(close, lambda x: x.bitwiseAND(low).cast("int")), lambda p: F.struct(F.get(w, p).alias("h"), p.alias("p"))))
        places = let(full, lambda s: F.transform(twice(s, lambda x, y: x["h"] == y["h"]), lambda x: x["p"]))
        return let(F.sort_array(places), covered)

    def counted(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(found(w))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(hashes, lambda h: let(windows(h, width), counted)))


def measures(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", domain_col: str = "source") -> DataFrame:
    """One slim row for each document: its domain, counts and failed rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.col(domain_col).alias("domain"),
        words_of(F.col("text")).alias("words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
    ).select(
        "doc_id",
        "text_hash",
        "domain",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"),
        F.col("lines.n").alias("n_lines"),
        repeated_words(F.col("words"), rules.window).cast("long").alias("n_repeat_words"),
    )
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))
    soft = [
        100 * F.col("n_symbols") > rules.max_symbol_pct * F.col("n_words"),
        100 * F.col("n_dup_lines") > rules.max_dup_line_pct * F.col("n_lines"),
        F.col("word_chars") > rules.max_mean_word * F.col("n_words"),
    ]
    return counted.withColumn("base_failed", base).withColumn("n_failed", sum((x.cast("int") for x in soft), F.lit(0)))


def domain_verdicts(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each domain: documents, failures, shrunk failure rate and verdict (reject, good or normal).

    The beta prior comes from the moments of the domains' rates, weighted by their documents; where the rates do not
    differ more than chance, the prior is as strong as one average domain.
    """
    failed = (F.col("base_failed") | (F.col("n_failed") > 0)).cast("long")
    hosts = measured.groupBy("domain").agg(F.count("*").alias("n"), F.sum(failed).alias("f"))
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n_all"), F.sum("f").alias("f_all"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff"))
    mean = F.col("f_all") / F.col("n_all")
    even = F.col("n_all") / F.col("hosts")
    spread = F.col("ff") / F.col("n_all") - mean * mean  # weighted variance of the rates
    noise = mean * (1 - mean) / even
    between = F.greatest(spread - noise, F.lit(0.0))
    strength = F.when(between > 0, F.least(even, F.greatest(F.lit(1.0), mean * (1 - mean) / between - 1))).otherwise(even)
    prior = total.select(mean.alias("prior_mean"), strength.alias("prior_strength"))
    rate = (F.col("f") + F.col("prior_mean") * F.col("prior_strength")) / (F.col("n") + F.col("prior_strength"))
    verdict = F.when(F.col("host_rate") > rules.reject_rate, "reject").when(F.col("host_rate") < rules.good_share * F.col("prior_mean"), "good").otherwise("normal")
    # the prior is one row by construction
    return hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", rate).withColumn("host_verdict", verdict).select("domain", "n", "f", "host_rate", "host_verdict")


def judged(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", domain_col: str = "source") -> DataFrame:
    """The measures of every document with the verdict of its domain and ``kept``.

    Kept: not failed by the base rules, its domain not rejected, and no further rule failed (one, in a good domain).
    """
    measured = cut(measures(docs, rules, id_col, domain_col))
    hosts = domain_verdicts(measured, rules).select(F.col("domain").alias("of"), "host_rate", "host_verdict")
    allowed = F.when(F.col("host_verdict") == "good", 1).otherwise(0)
    kept = ~F.col("base_failed") & (F.col("host_verdict") != "reject") & (F.col("n_failed") <= allowed)
    return measured.join(hosts, F.col("domain").eqNullSafe(F.col("of")), "left").withColumn("kept", kept).drop("of")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"), "n_failed")


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(text, '') t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l
  from documents),
win as (select doc_id, p, array_to_string(w[p:p+4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) p from d)),
rep as (select doc_id, p from win qualify count(*) over (partition by doc_id, g) > 1),
cov as (select doc_id, count(distinct p + o) n from rep, (select unnest(range(0, 5)) o) group by 1),
m as (
  select d.doc_id, source, len(w) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines,
    len(l) n_lines, coalesce(cov.n, 0) n_repeat_words
  from d left join cov on cov.doc_id = d.doc_id),
f as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
    (100 * n_symbols > 10 * n_words)::int + (100 * n_dup_lines > 30 * n_lines)::int + (word_chars > 20 * n_words)::int n_failed from m),
h as (select source, count(*) n, sum((base_failed or n_failed > 0)::int)::double f from f group by 1),
a as (select count(*)::double hosts, sum(n)::double n_all, sum(f) f_all, sum(f * f / n) ff from h),
b as (select f_all / n_all mu, n_all / hosts even, greatest(ff / n_all - (f_all / n_all) * (f_all / n_all) - (f_all / n_all) * (1 - f_all / n_all) / (n_all / hosts), 0.0) between_ from a),
p as (select mu, case when between_ > 0 then least(even, greatest(1.0, mu * (1 - mu) / between_ - 1)) else even end s from b),
v as (select source, (f + mu * s) / (n + s) rate, mu from h, p)
select f.doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
  n_repeat_words::bigint n_repeat_words, base_failed,
  not base_failed and not rate > 0.5 and n_failed <= case when rate < 0.5 * mu then 1 else 0 end kept,
  round(rate, 6) host_rate, n_failed
from f join v on f.source is not distinct from v.source
"""
