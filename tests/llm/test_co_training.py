"""Co-training against a plain version of its rounds and calibration on dense matrices."""

import random

import numpy as np
import pyarrow as pa

from traceqc.llm import grams, quality_classifier as q

T = q.Training(max_labelled=70, rounds=2, exchanged=6, confident=0.7, iterations=60)
SCHEMA = "doc_id long, text string, lang string, source string, place long, y double"


def corpus():
    rng = random.Random(3)
    good, bad = [f"fine{k}" for k in range(30)], [f"junk{k}" for k in range(30)]
    docs, labels = [], []
    for i in range(160):
        kind = rng.random() < 0.55
        own, other = (good, bad) if kind else (bad, good)
        text = " ".join(rng.choice(own if rng.random() < 0.7 else other) for _ in range(rng.randint(4, 30)))
        docs.append((i, text, rng.choice(["en", "de"]), "clean" if kind == (rng.random() < 0.8) else "dirty", 5, 0.5))
        if i < 110:
            labels.append((i, int(kind), int(not kind and i % 5 == 0)))
    docs += [(None, "fine1 fine2", "en", "clean", 1, 0.1), (3, "zzz", None, None, 1, 0.1), (200, None, "en", None, 1, 0.1), (201, "", None, "dirty", 1, 0.1)]
    labels += [(4, 0, 0), (150, None, 0), (None, 1, 0)]
    return docs, labels


def dense(rows: q.Rows, n):
    out = np.zeros((len(rows.first) - 1, n))
    for r, (a, b) in enumerate(zip(rows.first[:-1], rows.first[1:])):
        np.add.at(out[r], rows.index[a:b], rows.value[a:b])
    return out


def sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def adam(x, y):
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, T.iterations + 1):
        g = x.T @ (sig(x @ w) - y) / len(y) + T.l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def platt(z, y):
    z = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = sig(z @ w)
        h = z.T @ (z * (p * (1 - p))[:, None]) / len(y) + 1e-3 * np.eye(len(w))
        w = w - np.linalg.inv(h) @ (z.T @ (p - y) / len(y) + 1e-3 * w)
    return w


def plain(spark, docs, labels):
    """Scores in order of ``docs``."""
    frame = q.with_meta(spark.createDataFrame(docs, SCHEMA), "doc_id")
    rows = frame.withColumn("at", q.place_of(T)).collect()
    batch = pa.RecordBatch.from_pylist([{"text": r.text, **{f"m{k}": r[f"m{k}"] for k in range(4)}} for r in rows])
    data, offsets = grams.buffers(batch.column("text"))
    x = [dense(q.text_view(data, offsets), q.TEXT), dense(q.meta_view(batch), q.META)]
    ids = [r.doc_id for r in rows]
    at = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None and (r.doc_id not in at or (r.text or "") < (rows[at[r.doc_id]].text or "")):
            at[r.doc_id] = k
    truth = {}
    for i, quality, toxic in labels:
        if i is not None and quality is not None:
            truth[i] = min(truth.get(i, 1.0), float(quality == 1 and not toxic))
    own = sorted((i for i in truth if i in at), key=lambda i: rows[at[i]]["at"])[: T.max_labelled]
    y = np.array([truth[i] for i in own])
    cut = len(y) - round(len(y) * T.held_out)
    mine = [at[i] for i in own]
    extra = [{}, {}]
    free = [i for i in at if i not in truth]
    for round_ in range(T.rounds + 1):
        w = [adam(np.concatenate([x[k][mine[:cut]], x[k][[at[i] for i in extra[k]]]]), np.concatenate([y[:cut], list(extra[k].values())])) for k in range(2)]
        if round_ == T.rounds:
            break
        given = [{}, {}]
        for k in range(2):
            for label in (1.0, 0.0):
                sure = {i: round(float(p if label else 1 - p), 9) for i in free for p in [np.round(sig(x[k][at[i]] @ w[k]), 9)]}
                best = sorted((i for i in free if sure[i] >= T.confident), key=lambda i: (-sure[i], rows[at[i]]["at"]))[: T.exchanged * (round_ + 1)]
                given[1 - k].update(dict.fromkeys(best, label))
        for k in range(2):
            extra[k].update(given[k])
    z = []
    for k in range(2):
        h = np.clip(x[k] @ w[k], -30, 30)
        c = platt(h[mine[cut:]][:, None], y[cut:])
        z.append(h * c[0] + c[1])
    z = np.stack(z, axis=1)
    c = platt(z[mine[cut:]], y[cut:])
    assert all(extra), "the rounds exchange something"
    return [(i, round(float(p), 5)) for i, p in zip(ids, sig(z @ c[:2] + c[2]))]


def test_scores_equal_the_plain_version(spark):
    docs, labels = corpus()
    expected = plain(spark, docs, labels)
    got = q.scored(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), T).collect()
    assert len(got) == len(docs)
    assert all(r.kept == (r.score >= T.threshold) for r in got)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for (i, a), (j, b) in zip(sorted(((r.doc_id, r.score) for r in got), key=key), sorted(expected, key=key)):
        assert i == j and abs(a - b) < 2e-3
