"""Quality classifier by co-training of two views.

The text view sees hashed words, hashed word endings and a few shares of the text; the metadata view sees language,
source and length. Each is a logistic regression, fitted on a bounded sample of labelled documents (``max_labelled``)
and, round by round, on pseudo-labels: in each round both views score all documents without a label in one pass, and
those about which one view is most confident (``exchanged`` of each kind, more in later rounds) are labels for the other.
Held-out labelled documents then calibrate both views and weigh them against each other; the calibrated combination
scores every document in one pass with weight vectors of fixed size. Good is ``quality = 1`` and not toxic.

The labelled sample is that of the smallest hashes of ids, so it is the same in every run. Only it and the exchanged
documents reach the driver, one row an id.

Defined results: null and empty texts have the empty text view; null languages and sources are values of their own; a
document labelled more than once counts with its worst labels; of rows that repeat an id, that of the smallest text is
in the sample; documents of equal confidence rank by the hash of their id; rows without an id are scored but never
exchanged; without labels of both kinds all documents get the share of good labels (0.5 without any) as score; repeated
rows are scored one by one; texts of any length are read whole; an empty table gives an empty result; further columns, of
whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceqc.llm import grams
from traceqc.llm.common import cut, table

WORDS, ENDINGS, DENSE, META = 1 << 15, 1 << 11, 6, 1 << 10
TEXT = WORDS + ENDINGS + DENSE


@dataclass(frozen=True)
class Training:
    max_labelled: int = 6_000
    rounds: int = 3
    exchanged: int = 150  # pseudo-labels of each kind that a view gives in a round
    confident: float = 0.9
    held_out: float = 0.25
    iterations: int = 120
    l2: float = 2e-4
    threshold: float = 0.5
    seed: str = "co-training"


@dataclass
class Rows:
    """A sparse matrix by rows."""

    first: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        # each row is summed on its own, so the result doesn't depend on the rows beside it
        n = len(self.first) - 1
        return np.bincount(np.repeat(np.arange(n), np.diff(self.first)), w[self.index] * self.value, n)

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.index, np.repeat(g, np.diff(self.first)) * self.value, n)

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.first)[rows]
        first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        at = np.repeat(self.first[rows] - first[:-1], n) + np.arange(first[-1])
        return Rows(first, self.index[at], self.value[at])


def text_view(data: np.ndarray, offsets: np.ndarray) -> Rows:
    """Features of the texts of a slice: which words and endings they hold, and shares in ten steps' tenths."""
    n = len(offsets) - 1
    w = grams.words(data, offsets, grams.blank_table())
    counts = np.diff(w.first)
    doc = np.repeat(np.arange(n), counts)
    ids = (w.hash % np.uint64(WORDS)).astype(np.int64)
    last = w.data[w.end - 1].astype(np.int64)
    before = np.where(w.end - 2 >= w.start, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    ending = WORDS + (last * 257 + before * 31) % ENDINGS
    keys = np.unique(np.concatenate([doc * TEXT + ids, doc * TEXT + ending]))
    size = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in "#*$%&|<>!"]] = True
    distinct = np.bincount(keys[keys % TEXT < WORDS] // TEXT, minlength=n)
    dense = np.stack(
        [
            np.ones(n),
            20 * share(symbol[data]) if len(data) else np.zeros(n),
            4 * share((data >= 65) & (data < 91)) if len(data) else np.zeros(n),
            1 - distinct / np.maximum(counts, 1),
            np.minimum(size / np.maximum(counts, 1) / 10, 3),
            np.log1p(counts) / 10,
        ],
        axis=1,
    )
    rows = np.concatenate([keys // TEXT, np.repeat(np.arange(n), DENSE)])
    index = np.concatenate([keys % TEXT, np.tile(WORDS + ENDINGS + np.arange(DENSE), n)])
    value = np.concatenate([np.ones(len(keys)), dense.ravel()])
    order = np.argsort(rows, kind="stable")
    return Rows(np.searchsorted(rows[order], np.arange(n + 1)), index[order], value[order])


def meta_view(batch: pa.RecordBatch) -> Rows:
    """Features of the metadata: hashed language, source, their pair, and the length in powers of two."""
    n = batch.num_rows
    ids = np.stack([np.asarray(batch.column(c).fill_null(0).to_numpy(zero_copy_only=False), np.int64) for c in ("m0", "m1", "m2", "m3")], axis=1)
    index = np.concatenate([ids, np.full((n, 1), META - 1)], axis=1)
    return Rows(np.arange(n + 1) * 5, index.ravel(), np.ones(n * 5))


def with_meta(docs: DataFrame, id_col: str) -> DataFrame:
    """Id, text and the four metadata features."""
    hashed = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(META - 1)).cast("long")
    length = F.floor(F.log2(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1))))
    features = [hashed(F.lit("lang"), F.col("lang")), hashed(F.lit("source"), F.col("source")), hashed(F.lit("both"), F.col("lang"), F.col("source")), hashed(F.lit("length"), length)]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "text", *(f.alias(f"m{k}") for k, f in enumerate(features)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(x: Rows, y: np.ndarray, n: int, iterations: int, l2: float) -> np.ndarray:
    """Logistic regression by Adam on the whole sample."""
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(1, iterations + 1):
        g = x.back(sigmoid(x.dot(w)) - y, n) / max(1, len(y)) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def line(z: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression on a few dense columns by Newton steps, with intercept last."""
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, z.T @ (p - y) / len(y) + l2 * w)
    return w


@dataclass
class Model:
    """Weights of both views and of their calibrated combination; ``constant`` stands for all where nothing was fitted."""

    text: np.ndarray
    meta: np.ndarray
    calibration: list
    combined: np.ndarray
    constant: float | None = None

    def score(self, text: Rows, meta: Rows) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(text.first) - 1, self.constant)
        z = np.stack([np.clip(v.dot(w), -30, 30) * c[0] + c[1] for v, w, c in zip((text, meta), (self.text, self.meta), self.calibration)], axis=1)
        return sigmoid(z @ self.combined[:2] + self.combined[2])


def stacked(a: Rows, b: Rows) -> Rows:
    return Rows(np.concatenate([a.first, a.first[-1] + b.first[1:]]), np.concatenate([a.index, b.index]), np.concatenate([a.value, b.value]))


def co_trained(views: tuple[Rows, Rows], y: np.ndarray, exchange: Callable, t: Training) -> Model:
    """The model after all rounds. Rows of ``views`` are in hash order, so their tail is a random held-out part.

    ``exchange(weights, round)`` gives for each view the rows that the other view labels in this round, with their
    labels, or nothing where there is nothing to label.
    """
    good = float(y.mean()) if len(y) else 0.5
    n_fit = len(y) - round(len(y) * t.held_out)
    if n_fit < 10 or len(np.unique(y[:n_fit])) < 2 or len(np.unique(y[n_fit:])) < 2:
        return Model(np.zeros(TEXT), np.zeros(META), [(1, 0)] * 2, np.zeros(3), good)
    widths = (TEXT, META)
    own = [v.take(np.arange(n_fit)) for v in views]
    weights = [fit(own[k], y[:n_fit], widths[k], t.iterations, t.l2) for k in range(2)]
    for round_ in range(t.rounds):
        given = exchange(weights, round_)
        if given is None:
            break
        weights = [fit(stacked(own[k], given[k][0]), np.concatenate([y[:n_fit], given[k][1]]), widths[k], t.iterations, t.l2) for k in range(2)]
    held = [np.clip(v.take(np.arange(n_fit, len(y))).dot(w), -30, 30) for v, w in zip(views, weights)]
    calibration = [tuple(line(h[:, None], y[n_fit:])) for h in held]
    z = np.stack([h * c[0] + c[1] for h, c in zip(held, calibration)], axis=1)
    return Model(*weights, calibration, line(z, y[n_fit:]))


def views_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Rows, Rows]]:
    for batch in batches:
        for part, data, offsets in grams.sliced(batch):
            yield part, text_view(data, offsets), meta_view(part)


def sample(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray, tuple[Rows, Rows]]:
    """(ids, y, features) of the documents in ``ids`` (doc_id, place, y; of bounded size), in order of place."""

    def run(batches):
        for part, text, meta in views_of(batches):
            cells = [pa.array([r[a:b] for a, b in zip(v.first[:-1], v.first[1:])], kind) for v in (text, meta) for r, kind in ((v.index, pa.list_(pa.int32())), (v.value, pa.list_(pa.float32())))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "place", "y")), *cells], ["doc_id", "place", "y", "ti", "tv", "mi", "mv"])

    chosen = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.col("text"), *(f"m{k}" for k in range(4)), "place", "y")).alias("_r")).select("doc_id", "_r.*")
    rows = chosen.mapInArrow(run, "doc_id long, place long, y double, ti array<int>, tv array<float>, mi array<int>, mv array<float>")
    got = rows.toPandas().sort_values("place", kind="stable")

    def joined(index, value):
        first = np.concatenate([[0], np.cumsum([len(x) for x in got[index]])]).astype(np.int64)
        flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *got[c]]).astype(kind)
        return Rows(first, flat(index, np.int64), flat(value, np.float64))

    return got["doc_id"].to_numpy(np.int64), got["y"].to_numpy(np.float64), (joined("ti", "tv"), joined("mi", "mv"))


def nominated(rows: DataFrame, labelled: DataFrame, weights: list[np.ndarray], most: int, t: Training) -> list[list[tuple[int, float]]]:
    """For each view, the (id, label) of the ``most`` documents of each label that it is surest of, at least ``confident``.

    All documents without a label are scored by both views where they are read; only slim rows that one of them
    is confident of are written.
    """

    def run(batches):
        for part, text, meta in views_of(batches):
            p = [np.round(sigmoid(v.dot(w)), 9) for v, w in zip((text, meta), weights)]
            sure = np.flatnonzero(np.max([np.maximum(x, 1 - x) for x in p], axis=0) >= t.confident)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(sure)), *(pa.array(x[sure]) for x in p)], ["doc_id", "p0", "p1"])

    sure = rows.where("doc_id is not null").select("doc_id", "text", *(f"m{k}" for k in range(4))).mapInArrow(run, "doc_id long, p0 double, p1 double")
    sure = cut(sure.groupBy("doc_id").agg(F.max("p0").alias("p0"), F.max("p1").alias("p1")).join(labelled.select("doc_id"), "doc_id", "left_anti"))
    out = []
    for k in range(2):
        own: list[tuple[int, float]] = []
        for label, p in ((1.0, F.col(f"p{k}")), (0.0, 1 - F.col(f"p{k}"))):
            best = sure.where(p >= t.confident).orderBy(p.desc(), place_of(t)).limit(most).select("doc_id").collect()
            own += [(r["doc_id"], label) for r in best]
        out.append(own)
    return out


def place_of(t: Training) -> Column:
    """What orders ids at random, alike in every run."""
    return F.xxhash64(F.lit(t.seed), F.col("doc_id"))


def trained(docs: DataFrame, labels: DataFrame, t: Training, id_col: str = "doc_id") -> Model:
    rows = with_meta(docs, id_col)
    spark = docs.sparkSession
    labelled = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    labelled = cut(labelled.agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("double")).alias("y")))
    known = labelled.join(rows.select("doc_id").distinct(), "doc_id").select("doc_id", place_of(t).alias("place"), "y").orderBy("place").limit(t.max_labelled)
    _, y, views = sample(rows, known)
    extra: list[dict[int, float]] = [{}, {}]  # for each view, document: label that the other view gave

    def exchange(weights, round_):
        for k, own in enumerate(nominated(rows, labelled, weights, t.exchanged * (round_ + 1), t)):
            extra[1 - k].update(own)
        every = sorted({*extra[0], *extra[1]})
        if not every:
            return None
        ids = spark.createDataFrame([(i,) for i in every], "doc_id long").select("doc_id", place_of(t).alias("place"), F.lit(None).cast("double").alias("y"))
        got, _, features = sample(rows, ids)
        chosen = [np.array([r for r, i in enumerate(got.tolist()) if i in extra[k]], np.int64) for k in range(2)]
        return [(features[k].take(chosen[k]), np.array([extra[k][int(got[r])] for r in chosen[k]])) for k in range(2)]

    return co_trained(views, y, exchange, t)


def scored(docs: DataFrame, labels: DataFrame, t: Training = Training(), id_col: str = "doc_id") -> DataFrame:
    """Score (the calibrated chance of being good) and verdict of every document."""
    model = trained(docs, labels, t, id_col)

    def run(batches):
        for part, text, meta in views_of(batches):
            score = model.score(text, meta)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(score >= t.threshold)], ["doc_id", "score", "kept"])

    return with_meta(docs, id_col).mapInArrow(run, "doc_id long, score double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
