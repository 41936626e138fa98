"""Centroid clustering against plain Lloyd rounds that scan every vector."""

import hashlib
import math
import random

import numpy as np
import pytest

from traceqc.llm import centroids
from traceqc.llm.centroids import Lloyd

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def plain(rows, how):
    """Cluster and distance by id, the centroids, for rows that count."""
    good = [(i, [math.floor(float(np.float32(x)) * how.scale) for x in v]) for i, v in rows if v is not None and len(v) == how.components and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"{how.seed}{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in drawn[: how.k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(how.rounds):
        groups = [[] for _ in centres]
        for _, v in good:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centres)]
    return sorted(((i, *reversed(nearest(v))) for i, v in good), key=str), centres


def run(spark, rows, how):
    out, centres, story = centroids.clustered(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA), how)
    return sorted((tuple(r) for r in out.collect()), key=str), centres.at.tolist(), story


def grouped(n, components, seed, spread=0.05):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(components)] for _ in range(12)]
    return [(i, [m + rng.gauss(0, spread) for m in rng.choice(middles)]) for i in range(n)]


def test_equals_plain_rounds_and_scans_less(spark):
    how = Lloyd(k=8, rounds=10, components=6, block=64)
    rows = grouped(1500, 6, 1, 0.4)
    got, centres, story = run(spark, rows, how)
    assert (got, centres) == plain(rows, how)
    assert story[0] == (1500, 1500)
    assert all(moved <= scanned for scanned, moved in story)
    assert sum(s for s, _ in story[1:]) < 0.8 * 1500 * (len(story) - 1)  # most gaps have not expired


@pytest.mark.parametrize("n", [0, 3, 5])
def test_fewer_vectors_than_centroids(spark, n):
    how = Lloyd(k=5, rounds=3, components=4, block=2)
    rows = grouped(n, 4, 2)
    assert run(spark, rows, how)[:2] == (plain(rows, how) if n else ([], []))


def test_odd_rows(spark):
    how = Lloyd(k=3, rounds=4, components=3, block=4)
    rows = grouped(40, 3, 3)
    odd = [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [1.0, math.nan, 2.0]), (105, [math.inf, 0.0, 0.0]), (106, [-math.inf, 0.0, 0.0]), (None, [0.1, 0.2, -0.3]), (None, [0.5, 0.2, -0.3])]
    rows = [*rows, *odd, *rows[:5], *[(200 + i, [0.25, 0.25, 0.25]) for i in range(30)]]
    assert run(spark, rows, how)[:2] == plain(rows, how)


def test_ties_go_to_the_smaller_number(spark):
    """Vectors half way between centroids, and equal vectors only."""
    how = Lloyd(k=2, rounds=3, components=1, scale=1, block=3)
    rows = [(i, [float(x)]) for i, x in enumerate([0, 4, 2, 2, 2, 0, 4, 2, -3, 7])]
    assert run(spark, rows, how)[:2] == plain(rows, how)
    same = [(i, [3.0]) for i in range(9)]
    got, centres, _ = run(spark, same, how)
    assert {c for _, c, _ in got} == {0} and (got, centres) == plain(same, how)


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="or more"):
        run(spark, [(1, [1e9, 0.0])], Lloyd(k=1, rounds=1, components=2))


def test_rounds_exchange_nothing(spark):
    how = Lloyd(k=2, rounds=1, components=2)
    out, _, _ = centroids.clustered(spark.createDataFrame([(i, [float(i), 1.0], 1, "x") for i in range(20)], SCHEMA), how)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
