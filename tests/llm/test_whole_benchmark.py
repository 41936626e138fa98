"""Decontamination of documents that are shorter than an item."""

import math
from collections import Counter

import brute
import numpy as np

from traceqc.llm import decontamination


def contaminated(docs, items, least=0.8):
    """As in brute, with a document shorter than the item as one window."""
    own = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in items for w in [brute.words(t)] if len(w) > 4}
    df = Counter(x for c in own.values() for x in c)
    weight = lambda x: round(16 * (1 + math.log(len(own) / df.get(x, 1))))
    out = {}
    for d, t in docs:
        w = brute.words(t)
        s = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for i, c in own.items():
            n = sum(c.values())
            for p in range(max(1, len(s) - n + 1)):
                win = Counter(s[p : p + n])
                low = sum(min(win[x], c[x]) * weight(x) for x in c)
                high = sum(max(win[x], c[x]) * weight(x) for x in win.keys() | c.keys())
                if low / high >= least:
                    out[d, i] = max(out.get((d, i), 0), low / high)
    return {k: round(v, 9) for k, v in out.items()}


def found(spark, docs, items, **search):
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.contaminated(docs, items, decontamination.Search(**search)).collect()
    assert all(r.start_word == 0 or r.n_words > 4 for r in rows)
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows}, {(r.doc_id, r.item_id): r.n_words for r in rows}


def test_a_document_shorter_than_the_item_is_found(spark):
    item = [f"word{k}" for k in range(60)]
    docs = [(1, " ".join(item[:-1])), (2, " ".join(item[4:])), (3, " ".join(item[3:-5])), (4, " ".join(item[:40])), (5, " ".join(item[:-1] + ["z"] * 4)), (6, " ".join(item[:4])), (7, " ".join(f"w{k}" for k in range(30)) + " " + " ".join(item[:-2]))]
    items = [(1, " ".join(item)), (2, " ".join(f"w{k}" for k in range(31))), (3, "a b c d e")]
    got, n_words = found(spark, docs, items)
    assert got == contaminated(docs, items)
    assert {d for d, i in got if i == 1} >= {1, 2, 3}
    assert [n_words[d, 1] for d in (1, 2, 3)] == [59, 56, 52]


def test_groups_of_items_change_no_similarity(spark):
    head, tail = [[f"{name}{k}" for k in range(20)] for name in ("head", "tail")]
    items = [(i, " ".join(head + [f"item{i}x{k}" for k in range(25)] + tail)) for i in range(12)] + [(12, " ".join(tail + head))]
    # words of the item that differ in shared or in own shingles, so that weights decide
    docs = []
    for i in range(12):
        w = items[i][1].split()
        docs += [(10 * i, " ".join(w[:-i] if i else w)), (10 * i + 1, " ".join([*w[:22], "z", *w[23:]])), (10 * i + 2, " ".join([*tail[:i], *w[i:]])), (10 * i + 3, " ".join(w[i // 2 :]))]
    one = found(spark, docs, items)[0]
    assert one == contaminated(docs, items)
    assert found(spark, docs, items, max_items=1)[0] == one
    assert found(spark, docs, items, max_items=4)[0] == one


def test_items_of_one_template_take_little_memory():
    """Many items share template words; a long clean text repeats them, another holds one item."""
    import random
    import tracemalloc

    rng = random.Random(9)
    head, tail = "choose the one best answer to this".split(), "mark it".split()
    items = [(i, " ".join([*head, *(f"q{rng.randrange(10**6)}" for _ in range(25)), *tail])) for i in range(8000)]
    index = decontamination.Items(items, decontamination.Search())
    clean = " ".join(" ".join([*head, *(f"x{rng.randrange(10**6)}" for _ in range(18)), *tail]) for _ in range(4000))
    dirty = clean[:200_000] + " " + items[4321][1] + " " + clean[200_000:400_000]
    tracemalloc.start()
    s, d = decontamination.shingles_of(clean), decontamination.shingles_of(dirty)
    assert index.matches(s, np.array([0, len(s)])) == {}
    assert {k for _, k in index.matches(d, np.array([0, len(d)]))} == {4321}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_candidates_come_in_parts_without_loss(monkeypatch):
    """Windows like many items: the same pairs, however few are looked at at once."""
    import random

    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(2)}"
    items = [(i, " ".join(word() for _ in range(20))) for i in range(300)]
    index = decontamination.Items(items, decontamination.Search())
    s = decontamination.shingles_of(" ".join(word() for _ in range(2000)) + " " + items[5][1])
    prints = index.prints(s, np.arange(len(s) - 15), 16)
    pairs = lambda: [tuple(x) for w, m in index.candidates(prints, 16) for x in zip(w.tolist(), m.tolist())]
    whole = pairs()
    close = np.bitwise_count(prints[:, None] ^ index.sizes[16]["prints"][None, :]) <= decontamination.RADIUS
    assert whole == list(zip(*(x.tolist() for x in np.nonzero(close)))) and len(whole) > 30
    monkeypatch.setattr(decontamination, "PAIRS", 50)
    assert pairs() == whole
