"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceqc.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges`` (a, b), the smallest node that it reaches.

    In each round every node goes to the best of itself and its neighbours, and on to where that one goes; edges
    follow, and those within one node drop out. The best is the one of most neighbours in the first round (so stars
    are done at once) and the one of the smallest hash, another in each round, in all others: whatever the order of ids,
    half of the nodes or fewer are expected to be left after each, so rounds grow with the logarithm of the longest
    chain and the tables of all rounds together with the edges. Only their counts reach the driver.

    Defined results: loops and repeated edges count once; a node with no other neighbour than itself is no node here;
    an empty table gives an empty result.
    """
    left = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    moves = []
    while not left.isEmpty():
        k = len(moves)
        places = [F.xxhash64("b", F.lit(k)).alias("place"), F.xxhash64("a", F.lit(k)).alias("own")]
        if k == 0:
            degree = left.groupBy("a").agg((-F.count("*")).alias("degree"))
            ranked = left.join(degree.withColumnRenamed("a", "b"), "b").withColumnRenamed("degree", "near").join(degree, "a")
        else:
            ranked = left.withColumns({"near": F.lit(0), "degree": F.lit(0)})
        best = F.least(F.min(F.struct("near", "place", "b")), F.first(F.struct(F.col("degree").alias("near"), F.col("own").alias("place"), F.col("a").alias("b"))))
        first = cut(ranked.select("a", "b", "near", "degree", *places).groupBy("a").agg(best["b"].alias("to")))
        # every node that is left has an edge, so every target has a row of its own
        move = cut(first.join(first.select(F.col("a").alias("to"), F.col("to").alias("then")), "to").select(F.col("a").alias("node"), F.col("then").alias("to")))
        moves.append(move)
        ends = [move.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        moved = left.join(ends[0], "a").join(ends[1], "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        left = cut(moved.where("a <> b").distinct())
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    root = moves.pop().withColumnRenamed("to", "root")
    while moves:
        later = root.select(F.col("node").alias("to"), "root")
        root = cut(moves.pop().join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    low = root.groupBy("root").agg(F.min("node").alias("component"))
    return root.join(low, "root").select("node", "component")
