import random

import brute
import pytest

from traceqc.llm import jaccard_join, suffix_dedup
from traceqc.llm.common import cut
from traceqc.llm.components import components

SCHEMA = "doc_id long, text string, n long, sig string, member long, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], SCHEMA)


def varied(seed):
    """Groups of near copies, chains, copies, short and empty texts, repeated rows."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3)
    rows = [(0, None), (1, ""), (2, "  \t\n "), (3, "one"), (4, "One"), (5, "one two"), (6, "one  two")]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
            base = copy if rng.random() < 0.5 else base
    return [*rows, rows[9], rows[9]]


@pytest.mark.parametrize("width,percent,sizes", [(3, 90, {}), (5, 80, {}), (3, 90, {"block": 300, "cell": 2, "pivots": 2}), (3, 70, {"block": 150, "cell": 3, "pivots": 3})])
def test_components_equal_brute_force(spark, width, percent, sizes):
    rows = varied(width + percent)
    got = jaccard_join.joined(frame(spark, rows), jaccard_join.Join(width=width, percent=percent, **sizes)).collect()
    assert sorted(tuple(r) for r in got) == brute.components(rows, width, percent)


def test_regions_are_found_with_few_joins(spark, monkeypatch):
    """Each join of a small table is a table broadcast by the driver, and plans of many joins are what fills it: the
    near copies of sf0.01 took more than 1500 MB there."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(jaccard_join, "cut", noted)
    rows = varied(85)
    got = jaccard_join.joined(frame(spark, rows), jaccard_join.Join(width=5, percent=80)).collect()
    assert sorted(tuple(r) for r in got) == brute.components(rows, 5, 80)
    assert sum(plan.count("Join ") for plan in plans) <= 9


def test_jaccard_of_an_empty_table_and_missing_ids(spark):
    assert jaccard_join.joined(frame(spark, [])).count() == 0
    got = jaccard_join.joined(frame(spark, [(None, "a b c d"), (5, "a b c d"), (None, "x y z")])).collect()
    assert sorted((r.component_id is None, r.component_id) for r in got) == [(False, 5), (False, 5), (True, None)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_a_large_region_is_joined_in_recursion(spark):
    """Near copies of one text, all with other edits, far more than a cell holds."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 4, 8])):
            copy[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((i, " ".join(copy)))
    expected = brute.components(rows, 3, 90)
    for sizes in ({}, {"block": 3000, "cell": 4, "pivots": 3}):
        got = jaccard_join.joined(frame(spark, rows), jaccard_join.Join(**sizes)).collect()
        assert sorted(tuple(r) for r in got) == expected


def test_repeats_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(0, None), (1, ""), (2, "short")]
    for i in range(3, 60):
        kind = rng.random()
        if kind < 0.3:
            text = rng.choice(["ab ", "x", "abcdefg "]) * rng.randint(0, 60)
        elif kind < 0.6 and i > 10:
            a, b = (rows[rng.randrange(3, i)][1] for _ in range(2))
            text = a[rng.randint(0, 40) :] + "#" + b[: rng.randint(0, 200)]
        else:
            text = "".join(rng.choice("abcé 日") for _ in range(rng.randint(0, 300)))
        rows.append((i, text))
    rows += [rows[20], (7, "another text of the same id " * 9), (None, rows[30][1]), (None, "without an id " * 12)]
    key = lambda r: str(r)
    for length, most in ((200, 4096), (200, 2), (80, 3)):
        got = suffix_dedup.removed(frame(spark, rows).repartition(5), suffix_dedup.Dedup(length=length, block_bytes=4000, most_holders=most))
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute.repeats(rows, length), key=key)


def test_a_passage_that_all_documents_hold(spark):
    """It makes no large block: what is sorted at once stays small, and the counts are whole."""
    passage = "".join(random.Random(2).choice("abcdefgh ") for _ in range(320))
    rows = spark.range(20_000).selectExpr("id doc_id", f"concat('own ', id, ' ', '{passage}', ' end ', id * 7) text")
    got = suffix_dedup.removed(rows).groupBy("n_removed", "n_spans").count().collect()
    sizes = sorted((r.n_removed, r.n_spans, r["count"]) for r in got)
    assert sum(n for *_, n in sizes) == 20_000 and all(r >= len(passage) and s == 1 for r, s, _ in sizes)


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.removed(frame(spark, [])).count() == 0


def test_the_cover_reaches_all_pairs():
    shift = suffix_dedup.shifts()
    for i in range(31):
        for j in range(31):
            assert {(i + shift[i, j]) % 31, (j + shift[i, j]) % 31} <= set(suffix_dedup.RESIDUES)
