"""Rounds over graphs and chains: how many there are, and that plans don't grow with them."""

import random

import pytest
from pyspark.sql import functions as F

from traceqc.llm import common, warc
from traceqc.llm.components import components


def path(order):
    return list(zip(order[:-1], order[1:]))


def adverse(n):
    """The small ids at both ends."""
    return [2, *range(10, 10 + n - 2), 1]


@pytest.mark.parametrize("kind", ["random", "adverse"])
def test_a_path_of_2000_nodes(spark, kind, monkeypatch):
    order = {"random": random.Random(1).sample(range(2000), 2000), "adverse": adverse(2000)}[kind]
    sizes = []

    def spied(df):
        out = common.cut(df)
        sizes.append(int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return out

    monkeypatch.setattr("traceqc.llm.components.cut", spied)
    got = {r.node: r.component for r in components(spark.createDataFrame(path(order), "a long, b long")).collect()}
    assert got == dict.fromkeys(order, min(order))
    assert len(sizes) < 60 and max(sizes) < 1 << 20


def test_stars_loops_and_repeated_edges(spark):
    edges = [(500, k) for k in range(1, 400)] + [(7, 7), (900, 900), (901, 902), (902, 901), (901, 902)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys([*range(1, 400), 500], 1) | {901: 901, 902: 901}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_random_graphs_equal_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(420)]
    low = {x: x for e in edges for x in e}
    for _ in range(900):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    expected = {x: low[x] for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == expected


def test_a_chain_of_many_records_in_one_archive(spark):
    n = 1 << 17
    chain = spark.range(n).select(F.lit("f").alias("file"), (F.col("id") * 10).alias("off"), (F.col("id") * 10 + 10).alias("next"))
    false = spark.range(1000).select(F.lit("f").alias("file"), (F.col("id") * 10 + 3).alias("off"), (F.col("id") * 10 + 20).alias("next"))
    got = warc.reachable(chain.union(false))
    assert got.count() == n and got.where("off % 10 <> 0").count() == 0


def test_a_set_of_keys_grows_with_them(spark):
    """More keys than the least set has bits: still few other rows stay."""
    n = 1_500_000
    keys = common.cut(spark.range(n).select(F.col("id").alias("k")))
    rows = spark.range(2 * n).select(F.col("id").alias("k"), F.lit("x").alias("_chunk"))
    maybe, sure = common.split(rows, keys, "k")
    held, other = maybe.where(F.col("k") < n).count(), maybe.where(F.col("k") >= n).count()
    assert held == n and other < 0.1 * n
    assert maybe.columns == rows.columns and {r._chunk for r in maybe.select("_chunk").distinct().collect()} == {"x"}
    assert sure.count() == n - other
    assert common.split(rows, keys, "k", most_bits=20)[1] is None


def test_rows_of_null_and_present_keys(spark):
    rows = spark.createDataFrame([(None, 1), (1, 2), (2, 3), (2, 4)], "k long, v int")
    assert sorted(r.v for r in common.without(rows, rows.where("k = 2"), "k").collect()) == [1, 2]
    assert sorted(r.v for r in common.without(rows, rows.where("k is null"), "k").collect()) == [2, 3, 4]
    assert common.without(rows, rows.where("false"), "k").count() == 4


def test_what_is_between_steps_is_released(tmp_path, spark, monkeypatch):
    monkeypatch.setattr("traceqc.functions.lineage.shared_dir", lambda _: str(tmp_path))
    common.cut(spark.range(3))
    assert list(tmp_path.iterdir())
    common.released(spark)
    assert not list(tmp_path.iterdir())
