"""Alignment of pairs of documents: anchors, chains, moved blocks."""

import random

import brute
import numpy as np

from traceqc.llm import line_dedup


def rows_of(spark, rows):
    out = line_dedup.alignments(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted((r.later, r.earlier, r.first, r.end, r.earlier_first, r.moved) for r in out)


def passage(name, n=3):
    return [f"{name} passage, its line {k} of some" for k in range(n)]


def test_longest_chains_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        at = [rng.randrange(12) for _ in range(rng.randint(1, 9))]
        got = line_dedup.longest_chain(np.array(at))
        parts = [[x for k, x in enumerate(at) if m >> k & 1] for m in range(1 << len(at))]
        best = max(len(c) for c in parts if all(a < b for a, b in zip(c, c[1:])))
        chosen = [at[k] for k in got]
        assert len(got) == best and all(a < b for a, b in zip(chosen, chosen[1:])) and list(got) == sorted(got)


def test_blocks_in_order_and_a_moved_one(spark):
    one, two, three = passage("first", 4), passage("second", 4), passage("third", 2)
    rows = [(1, "\n".join(three + ["x"] + one + ["y"] + two)), (2, "\n".join(["a"] + one + ["b", "c"] + two + three))]
    assert rows_of(spark, rows) == [(2, 1, 1, 5, 3, False), (2, 1, 7, 11, 8, False), (2, 1, 11, 13, 0, True)]


def test_a_repeated_passage_goes_each_time(spark):
    one = passage("only")
    rows = [(1, "\n".join(["start"] + one)), (2, "\n".join(one + ["x"] + one + ["y"]))]
    assert {(r[2], r[3]) for r in rows_of(spark, rows)} == {(0, 3), (4, 7)}
    assert [r.gone for r in line_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [[0, 1, 2, 4, 5, 6]]


def test_repeated_alignment_finds_every_shared_run():
    """What the operator's SQL relies on: alignment, repeated on what it leaves, ends when no shared run is left."""
    rng = random.Random(5)
    for _ in range(400):
        pool = [c * rng.choice([10, 30, 60]) for c in "abcdefgh"]
        a, b = ([rng.choice(pool) for _ in range(rng.randint(2, 9))] for _ in range(2))
        assert brute.aligned(a, b, 50) == brute.shared_runs(a, b, 50)


def test_piles_grow_and_are_few():
    """Each pile is a chain in both documents; no cover by chains has fewer (it is as many as a longest run of falling ones)."""
    rng = random.Random(2)
    for _ in range(300):
        at = np.array([rng.randrange(10) for _ in range(rng.randint(1, 12))])
        pile = line_dedup.piles(at)
        for k in set(pile.tolist()):
            assert np.all(np.diff(at[pile == k]) > 0)
        falling = [1] * len(at)
        for i in range(len(at)):
            falling[i] = 1 + max((falling[j] for j in range(i) if at[j] >= at[i]), default=0)
        assert len(set(pile.tolist())) == max(falling)


def test_only_what_is_aligned_goes(spark, monkeypatch):
    """Chains decide: runs that no chain holds stay, and with the first chain alone moved passages do."""
    one, two = passage("first", 4), passage("second", 3)
    first, end, held = np.array([0, 4]), np.array([4, 7]), np.array([3, 0])
    assert sorted(zip(*(x.tolist() for x in line_dedup.blocks_of(first, end, held)))) == [(0, 4, 3, True), (4, 7, 0, False)]
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "piles", lambda held: np.full(len(held), -2))
        assert [x.tolist() for x in line_dedup.blocks_of(first, end, held)] == [[4], [7], [0], [False]]
        m.setattr(line_dedup, "chains", lambda first, held: np.full(len(first), -1))
        assert [len(x) for x in line_dedup.blocks_of(first, end, held)] == [0, 0, 0, 0]
    rows = [(1, "\n".join(two + one)), (2, "\n".join(one + two))]
    assert {(r[2], r[3], r[5]) for r in rows_of(spark, rows)} == {(0, 4, False), (4, 7, True)}


def test_pairs_and_holders(spark):
    """A document is paired with the first holder of each of its runs, several where these differ."""
    one, two = passage("one"), passage("two")
    rows = [(1, "\n".join(one + ["k"])), (2, "\n".join(two + ["l"])), (3, "\n".join(one + ["m"] + two)), (4, "\n".join(two + one))]
    assert {(r[0], r[1]) for r in rows_of(spark, rows)} == {(3, 1), (3, 2), (4, 1), (4, 2)}
