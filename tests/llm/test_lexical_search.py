"""Ranked lexical search against a plain version that scores every pair."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from traceqc.llm import grams, lexical_search
from traceqc.llm.lexical_search import Search

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(set)
    for i, x in items:
        wanted[i] |= set(terms(x))
    out = []
    for item, words in wanted.items():
        scores = []
        for doc, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, how=Search()):
    d = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in lexical_search.ranked(d, q, how).collect()), key=str)


def corpus(n, seed, words=400):
    rng = random.Random(seed)
    names = [rng.choice(["ab", "Cd", "é", "ñx", "7"]) + str(i) for i in range(words)]
    text = lambda most: " ".join(names[min(int(rng.expovariate(0.02)), words - 1)] for _ in range(rng.randint(1, most)))
    return [(i, text(60)) for i in range(n)], [(100 + i, text(15)) for i in range(40)]


@pytest.mark.parametrize("how", [Search(), Search(k=3, batch=64, group=16, leaf=4, block=8, items=2), Search(k=1, batch=8, group=4, leaf=2, block=3, items=2, max_terms=60)])
def test_equals_all_pairs(spark, how):
    docs, items = corpus(700, 1)
    docs += [(1000 + i, docs[5][1]) for i in range(15)]  # copies
    assert run(spark, docs, items, how) == plain(docs, items, how.k)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,-\x00"), (4, "Alpha beta"), (4, "Alpha beta"), (None, "alpha"), (None, "alpha"), (-5, "ALPHA alpha"), (6, "ärger Ärger"), (7, "common"), (8, "common alpha")]
    items = [(1, "alpha BETA alpha"), (2, None), (3, ""), (4, "nothing here"), (None, "ärger"), (5, "common"), (5, "beta"), (6, "Ärger")]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    assert run(spark, [(1, "alpha")], [(1, "alpha")]) == plain([(1, "alpha")], [(1, "alpha")])


def test_very_long_texts_are_read_in_pieces(spark):
    rng = random.Random(4)
    long_text = " ".join(f"w{rng.randrange(50)}" for _ in range(1_300_000)) + " " + "z" * (grams.SLICE + 5) + " tail"
    assert len(long_text) > 2 * grams.SLICE
    docs, items = [(1, long_text), (2, "tail w1 w2"), (3, "w49 z")], [(1, "w1 w2 w3"), (2, "tail"), (3, "z" * (grams.SLICE + 5))]
    assert run(spark, docs, items) == plain(docs, items)


def test_the_tree_prunes():
    """Of all pairs only a part is scored, and thresholds do it: without them more is."""
    import numpy as np
    import pyarrow as pa

    docs, items = corpus(2048, 7)
    names = sorted({t for _, x in items for t in terms(x)})
    number = {t: i for i, t in enumerate(names)}
    item, term = (np.array(x) for x in zip(*[(i, number[t]) for i, (_, x) in enumerate(items) for t in sorted(set(terms(x)))]))
    rows = [Counter(number[t] for t in terms(x) if t in number) for _, x in docs]
    df = Counter(t for r in rows for t in r)
    weights = np.array([lexical_search.weight(2048, df[t]) for t in range(len(names))])
    tree = lexical_search.Items.of(item, pa.array([i for i, _ in items]), term, weights)
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    flat = [(t, r[t]) for r in rows for t in sorted(r)]
    batch = lexical_search.Batch.of(pa.array([i for i, _ in docs]), first, np.array([t for t, _ in flat]), np.array([c for _, c in flat]), np.full(2048, 100))
    how = Search(batch=2048)
    best = lexical_search.Best(len(items), how.k)
    scored = lexical_search.descend(batch, tree, 0, len(items), best, how)
    every = lexical_search.descend(batch, tree, 0, len(items), lexical_search.Best(len(items), 10**6), how)
    assert scored < 0.7 * every <= 0.7 * 2048 * len(items)
