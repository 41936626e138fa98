"""Mixing sources to target weights: hierarchical budgeting over a domain, language, source tree.

A token budget goes down the tree. At each node it is shared among the children by weight; a child that can't use its
share (its documents, repeated ``max_epochs`` times, are too few) takes what it can and the shortage goes to its
siblings by weight. Only what no sibling can use reaches the parent's siblings, because a parent never takes more than
its children can: capacities are summed from the leaves up, and a leaf counts for nothing if it or a node above it has
weight 0. Each leaf then reads its documents in seeded epochs (another order each time) until its budget is
used: so many whole epochs, then a prefix of the next one.

The prefix is found without bringing a leaf together: an epoch's order is by hash, leaves are cut into ``16 **
bucket_digits`` hash ranges, sums of ranges tell where the budget ends, and only within ranges rows are ordered.

Defined results: null texts have no tokens; null languages or sources are the node ``(none)``; nodes without a given
weight have weight 1, those of weight 0 get nothing; repeated rows count each, and rows of one id are selected together
(so are those whose hashes tie, and rows without an id of one text, which are told apart by their texts); texts of any length count whole; columns of names that are used here are kept aside by
``mixture`` and ignored by ``mixed``; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceqc.llm.common import cut, table

LEVELS = ["domain", "language", "leaf_source"]
TOKEN = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Weights by level and node, the share of all tokens to select, and how often a document may be repeated."""

    weights: dict = field(
        default_factory=lambda: {
            "domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0},
            "language": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0},
            "leaf_source": {},
        }
    )
    budget_share: float = 0.6
    max_epochs: int = 3
    seed: str = "mix"
    bucket_digits: int = 3
    broadcast_rows: int = 50_000  # a leaf table of at most so many rows is broadcast


def domain_of(source: Column) -> Column:
    """The domain of a source: by the number at its end, modulo 4; ``other`` without one."""
    number = F.nullif(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit(""))
    return F.coalesce(F.concat(F.lit("domain"), (number.cast("long") % 4).cast("string")), F.lit("other"))


def weight_of(level: str, mix: Mix) -> Column:
    given = mix.weights.get(level) or {}
    out = F.lit(1.0)
    for node, weight in given.items():
        out = F.when(F.col(level) == node, F.lit(float(weight))).otherwise(out)
    return out


def fill(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """Adds ``given``: each node's part of its parent's budget, by weight, at most its capacity.

    With children in order of capacity for each unit of weight, those that fill up come first; the first that does not
    sets the rate of all that follow. One sort of the children of a node; no iteration.
    """
    order = Window.partitionBy(*parent).orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).asc_nulls_last(), *LEVELS[: len(parent) + 1])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    rate = (budget - F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("cap")).otherwise(0.0)).over(before), F.lit(0.0))) / F.sum("w").over(after)
    out = nodes.withColumn("rate", F.when(F.col("w") > 0, rate)).withColumn("place", F.row_number().over(order))
    every = Window.partitionBy(*parent)
    first = F.min(F.when((F.col("w") > 0) & (F.col("cap") > F.col("rate") * F.col("w")), F.col("place"))).over(every)
    out = out.withColumn("first", first)
    level = F.max(F.when(F.col("place") == F.col("first"), F.col("rate"))).over(every)
    given = F.when(F.col("w") <= 0, F.lit(0.0)).when(F.col("first").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return out.withColumn("level", level).withColumn("given", given).drop("rate", "place", "first", "level")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """One row for each leaf: its tokens, whole epochs and the tokens of the last, partial one."""
    open_ = F.lit(True)
    for level in LEVELS:
        open_ &= weight_of(level, mix) > 0
    nodes = leaves.withColumn("cap", F.when(open_, F.col("tokens") * float(mix.max_epochs)).otherwise(F.lit(0.0)))
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(mix.budget_share)).cast("double").alias("budget"))
    out = None
    for depth in range(len(LEVELS)):
        keys, parent = LEVELS[: depth + 1], LEVELS[:depth]
        level = nodes.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(keys[-1], mix))
        level = level.crossJoin(F.broadcast(total)) if out is None else level.join(out, parent)  # one row by construction
        out = fill(level, parent, F.col("budget")).select(*keys, F.col("given").alias("budget"))
    tokens = F.col("tokens")
    goal = F.least(F.floor(F.col("budget") + 1e-6), tokens * mix.max_epochs)
    whole = F.when(tokens > 0, F.floor(goal / tokens)).otherwise(F.lit(0)).cast("long")
    return leaves.join(out, LEVELS).withColumn("whole", whole).withColumn("rest", (goal - F.col("whole") * tokens).cast("long")).select(*LEVELS, "whole", "rest")


def with_leaf(docs: DataFrame) -> DataFrame:
    """Adds the three levels of a document's leaf."""
    return docs.withColumns({"domain": domain_of(F.col("source")), "language": F.coalesce("lang", F.lit("(none)")), "leaf_source": F.coalesce("source", F.lit("(none)"))})


def unnamed(id_col: str) -> Column:
    """What stands for the id of a document without one: a digest of its text."""
    return F.when(F.col(id_col).isNull(), F.concat(F.lit("text "), F.md5("text")))


def epoch_key(mix: Mix, id_col: str, text_name: Column) -> Column:
    """Where a document stands in the leaf's last epoch; ``text_name`` is ``unnamed``."""
    return F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("whole").cast("string"), F.coalesce(F.col(id_col).cast("string"), text_name)))


def with_plan(df: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """``df`` joined with the leaves' plan, which is broadcast up to ``broadcast_rows`` leaves."""
    small = plan.limit(mix.broadcast_rows + 1).count() <= mix.broadcast_rows
    return df.join(F.broadcast(plan) if small else plan, LEVELS)


def leaf_plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row for each leaf: whole epochs, and the last key of the prefix of the next one (null: none)."""
    leaves = cut(leaf_budgets(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), mix))
    planned = with_plan(rows, leaves, mix).where("rest > 0").withColumn("key", epoch_key(mix, "doc_id", F.col("unnamed"))).withColumn("range", F.substring("key", 1, mix.bucket_digits))
    cell = [*LEVELS, "range"]
    sums = planned.groupBy(*cell).agg(F.sum("n_tokens").alias("in_range"))
    order = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*cell, F.coalesce(F.sum("in_range").over(order), F.lit(0)).alias("start"))
    inner = Window.partitionBy(*cell).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))
    last = planned.join(starts, cell).where(F.col("start") < F.col("rest")).withColumn("before", before).where("before < rest").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    return cut(leaves.join(last, LEVELS, "left").select(*LEVELS, "whole", "last"))


def select(rows: DataFrame, plan: DataFrame, mix: Mix, id_col: str, text_name: Column) -> DataFrame:
    """The selected rows with ``copies``, the number of epochs that read them; rows of one id go together."""
    copies = F.col("whole") + F.coalesce(epoch_key(mix, id_col, text_name) <= F.col("last"), F.lit(False)).cast("long")
    return with_plan(rows, plan, mix).withColumn("copies", copies).where("copies > 0").drop("whole", "last")


def token_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A slim row for each document: id, leaf and tokens."""
    tokens = F.coalesce(F.regexp_count(F.col("text"), F.lit(TOKEN)), F.lit(0)).cast("long")
    return cut(with_leaf(docs).select(F.col(id_col).alias("doc_id"), unnamed(id_col).alias("unnamed"), *LEVELS, tokens.alias("n_tokens")))


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id") -> DataFrame:
    """The selected documents: id, leaf, tokens and copies."""
    rows = token_rows(docs, id_col)
    return select(rows, leaf_plan(rows, mix), mix, "doc_id", F.col("unnamed")).select("doc_id", *LEVELS, "n_tokens", "copies")


def mixture(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id") -> DataFrame:
    """The selected documents themselves, one row for each epoch that reads them, with the number of the ``epoch``.

    The leaves' plan is applied where documents are read; texts aren't shuffled.
    """
    columns = [c for c in docs.columns if c != "epoch"]
    plan = leaf_plan(token_rows(docs, id_col), mix)
    # a column of a level's name is kept aside
    kept = {c: f"_{c}" for c in columns if c in (*LEVELS, "whole", "last", "copies")}
    chosen = select(with_leaf(docs.select(*columns).withColumnsRenamed(kept)), plan, mix, id_col, unnamed(id_col))
    return chosen.select(*(F.col(kept.get(c, c)).alias(c) for c in columns), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def _weight(level: str, mix: Mix) -> str:
    given = mix.weights.get(level) or {}
    return f"case {_column(level)} " + " ".join(f"when '{n}' then {float(w)}::double" for n, w in given.items()) + " else 1.0::double end" if given else "1.0::double"


def _column(level: str) -> str:
    return f'"{level}"'


def _level(name: str, keys: list[str], mix: Mix, above: str) -> str:
    """SQL of one level of the tree."""
    part = f"partition by {', '.join(keys[:-1])}" if keys[:-1] else ""
    cols = ", ".join(keys)
    link = f"join {above} using ({', '.join(keys[:-1])})" if keys[:-1] else f"cross join {above}"
    ratio = "case when w > 0 then cap / w end"
    return f"""
{name}_n as (select {cols}, sum(cap) cap, {_weight(keys[-1].strip('"'), mix)} w from leaves group by {cols}),
{name}_r as (
  select {cols}, cap, w, row_number() over o place,
    (budget - coalesce(sum(case when w > 0 then cap else 0.0 end) over (o rows between unbounded preceding and 1 preceding), 0.0)) / nullif(sum(w) over (o rows between current row and unbounded following), 0.0) rate
  from {name}_n {link} window o as ({part} order by {ratio} nulls last, {cols})),
{name}_f as (select *, min(case when w > 0 and cap > rate * w then place end) over ({part}) f from {name}_r),
{name} as (
  select {cols}, case when w <= 0 then 0.0 when f is null then cap else least(cap, max(case when place = f then rate end) over ({part}) * w) end budget
  from {name}_f)"""


def oracle_for(mix: Mix) -> str:
    """DuckDB SQL for ``mixed`` over a table ``documents``."""
    levels = [_column(x) for x in LEVELS]
    cols = ", ".join(levels)
    is_open = " and ".join(f"{_weight(x, mix)} > 0" for x in LEVELS)
    return (
        rf"""
with d as (
  select doc_id, coalesce('domain' || (nullif(regexp_extract(source, '(\d{{1,9}})$', 1), '')::bigint % 4), 'other') "domain",
    coalesce(lang, '(none)') "language", coalesce(source, '(none)') "leaf_source",
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) n_tokens
  from documents),
leaves as (select {cols}, sum(n_tokens)::bigint tokens, case when {is_open} then sum(n_tokens) * {float(mix.max_epochs)}::double else 0.0 end cap from d group by {cols}),
total as (select floor(sum(tokens) * {mix.budget_share}::double) budget from leaves),"""
        + ",".join(_level(f"l{k + 1}", levels[: k + 1], mix, f"l{k}" if k else "total") for k in range(len(levels)))
        + rf""",
plan as (
  select {cols}, tokens, least(floor(budget + 1e-6)::bigint, tokens * {mix.max_epochs}) goal,
    case when tokens > 0 then goal // tokens else 0 end whole, goal - whole * tokens rest
  from leaves join l3 using ({cols})),
k as (select d.*, whole, rest, md5('{mix.seed}:' || whole || ':' || doc_id) key from d join plan using ({cols})),
s as (
  select *, coalesce(sum(n_tokens) over (partition by {cols} order by key, n_tokens rows between unbounded preceding and 1 preceding), 0) before_
  from k)
select doc_id, {cols}, n_tokens::bigint n_tokens, (whole + (before_ < rest)::int)::bigint copies
from s where whole + (before_ < rest)::int > 0
"""
    )


ORACLE = oracle_for(Mix())
