"""How documents that may link are brought together: tokens are what a set holds of a part of all shingles."""

import random

import brute
import numpy as np
import pytest

from traceqc.llm import jaccard_join


@pytest.mark.parametrize("percent", [95, 90, 80, 60])
def test_sets_that_link_share_enough_tokens(percent):
    """Pairs at the least similarity, of sizes from 1 to 1500, whatever the larger one is; sets with empty parts too."""
    rng, join, several = np.random.default_rng(percent), jaccard_join.Join(percent=percent), 0
    for _ in range(400):
        union = rng.permutation(np.unique(rng.integers(0, 1 << 64, int(np.exp(rng.uniform(0, 7.3))) + 1, np.uint64)))
        common = -(-percent * len(union) // 100)
        cut = common + rng.integers(0, len(union) - common + 1)
        if common == len(union):
            continue
        a, b = (jaccard_join.tokens(np.sort(s), join) for s in (union[:cut], np.concatenate([union[:common], union[cut:]])))
        assert any(len(np.intersect1d(x, y)) >= max(1, n, m) for n, x in a for m, y in b)
        several += any(len(g) > 2 for g in (a, b))
    assert several or percent > 80


def test_a_passage_that_many_documents_hold_brings_few_together(spark, monkeypatch):
    """They meet in no region of all of them, which would be tested in the square of their number."""
    rng, met = random.Random(4), []
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(i, f"{' '.join(f'w{rng.random()}' for _ in range(20))} {passage} {' '.join(f'w{rng.random()}' for _ in range(15))}") for i in range(600)]
    rows += [(1000 + i, f"{t} more") for i, t in rows[:5]]
    links = jaccard_join.links

    def noted(docs, member, join, id_col):
        met.append(member.count())
        return links(docs, member, join, id_col)

    monkeypatch.setattr(jaccard_join, "links", noted)
    got = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute.components(rows, 3, 90)
    assert 10 <= met[0] < 120
