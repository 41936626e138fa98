"""Ranked lexical search by a dual tree over items and documents.

One pass reads every text whole and keeps a document's number of terms and its counts of the items' terms; it is written
once, so that frequencies and the search read a slim table. The search is a descent of two hierarchies. Nodes over
documents (a batch, groups of leaves, leaves) hold for each term the largest contribution of their documents; nodes over
items (a block, groups, items) hold for each term the largest weight. The product of two nodes bounds every score below
them, so a pair whose bound is under the weakest k-th score of its items is dropped with all that is below it. Leaves
are taken by falling bounds, so that k-th scores rise early; what is left is scored exactly. Weights and contributions
are integers below 2 ** 53 in all sums, so products of doubles are exact.

Tasks share nothing: each returns its ``k`` best documents of every item, and a window keeps the best of these. Items
travel to the tasks in groups of at most ``max_terms`` (item, term) pairs, one more pass over the documents for each group.

Defined results: null and empty texts have no terms and neither count nor match; an item without terms has no rows; rows
of one item id are one item with all their terms, a null id too; repeated rows of documents are documents of their own
with equal scores; equal scores rank by ascending document id, null last; texts of any length are read in pieces that
end between terms; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceqc.llm import grams
from traceqc.llm.common import cut, table

#: Terms: runs of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Search:
    """``k`` documents an item; sizes of the nodes over documents (batch, group, leaf) and items (block, group)."""

    k: int = 10
    batch: int = 512
    group: int = 64
    leaf: int = 8
    block: int = 256
    items: int = 16
    max_terms: int = 1_000_000


def weight(total: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * holders + 1)))


def norm(words: np.ndarray, total: int, length: int) -> np.ndarray:
    """What the length of a document adds to the denominator; in whole numbers of any size."""
    return np.array([100 - 90 + 90 * n * total // length for n in words.tolist()], np.int64)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))


class Vocabulary:
    """Terms by number; looks the words of texts up by hash and compares their bytes."""

    def __init__(self, terms: list[str]):
        data = np.frombuffer(" ".join(terms).encode(), np.uint8)
        w = grams.words(data, np.array([0, len(data)]), grams.alnum_table())
        assert len(w.hash) == len(terms)
        self.number = np.argsort(w.hash, kind="stable").astype(np.int32)
        self.hash, self.data = w.hash[self.number], w.data
        self.start, self.size = w.start, w.end - w.start
        if (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two terms have one hash")

    def find(self, w: grams.Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are known, and their numbers."""
        if not len(self.hash) or not len(w.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        at = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        word = np.flatnonzero(self.hash[at] == w.hash)
        number = self.number[at[word]]
        size = w.end[word] - w.start[word]
        same = size == self.size[number]
        word, number, size = word[same], number[same], size[same]
        if len(word):
            first = np.cumsum(size) - size
            inner = np.arange(size.sum()) - np.repeat(first, size)
            equal = w.data[np.repeat(w.start[word], size) + inner] == self.data[np.repeat(self.start[number], size) + inner]
            same = np.logical_and.reduceat(equal, first)
            word, number = word[same], number[same]
        return word, number


def pieces(data: np.ndarray, most: int = grams.SLICE) -> Iterator[np.ndarray]:
    """One text in pieces of about ``most`` bytes that end between terms."""
    inside, at = grams.alnum_table()[grams.lower_table()], 0
    while at < len(data):
        to = at + most
        while to < len(data):
            gaps = np.flatnonzero(~inside[data[to : to + most]])
            to = to + int(gaps[0]) if len(gaps) else to + most
            if len(gaps):
                break
        yield data[at:to]
        at = to


def counted(data: np.ndarray, offsets: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each document; then document, term and count of each known term of a document, in this order."""
    n = len(offsets) - 1
    parts = [(data, offsets)] if n > 1 or len(data) <= 2 * grams.SLICE else [(p, np.array([0, len(p)])) for p in pieces(data)]
    words, keys = np.zeros(n, np.int64), []
    counts: list[np.ndarray] = []
    for d, o in parts:
        w = grams.words(d, o, grams.alnum_table())
        words += np.diff(w.first)
        word, number = known.find(w)
        doc = np.searchsorted(w.first, word, "right") - 1
        key, count = np.unique((doc << 32) | number, return_counts=True)
        keys.append(key)
        counts.append(count)
    key, where = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    count = np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    return words, key >> 32, key & 0xFFFFFFFF, count


def postings(documents: DataFrame, known: Broadcast) -> DataFrame:
    """(doc_id, n, terms, counts) of every document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in grams.sliced(batch):
                words, doc, term, count = counted(data, offsets, known.value)
                first = np.searchsorted(doc, np.arange(len(words) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32())) for x in (term, count)]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(words), *lists], ["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(words > 0))

    fields = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, counts array<int>"
    return documents.select("doc_id", "text").mapInArrow(run, fields)


@dataclass
class Items:
    """Items as sorted lists of term numbers, those with common terms beside each other, and the weights of all terms."""

    name: pa.Array
    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(item: np.ndarray, name: pa.Array, term: np.ndarray, weight: np.ndarray) -> Items:
        """From pairs of item and term: ordered by each item's commonest term, so that a node holds much alike."""
        commonest = np.full(len(name), -1, np.int64)
        order = np.lexsort((-weight[term], item))
        commonest[item[order]] = term[order]  # the last of an item: its smallest weight
        rank = np.argsort(commonest, kind="stable")
        place = np.empty(len(name), np.int64)
        place[rank] = np.arange(len(name))
        order = np.lexsort((term, place[item]))
        return Items(name.take(pa.array(rank)), np.searchsorted(place[item][order], np.arange(len(name) + 1)), term[order], weight)


class Best:
    """The ``k`` best documents of each item so far."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(n)], np.ones(n)

    def offer(self, item: int, score: int, missing: bool, doc: int) -> None:
        heap, entry = self.heaps[item], (score, not missing, -doc)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)
        if len(heap) == self.k:
            self.least[item] = heap[0][0]


@dataclass
class Batch:
    """Documents with their known terms and contributions, those with common terms beside each other."""

    doc: np.ndarray
    missing: np.ndarray
    row: np.ndarray
    term: np.ndarray
    gain: np.ndarray

    @staticmethod
    def of(docs: pa.Array, first: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> Batch:
        size = np.diff(first)
        row = np.repeat(np.arange(len(size)), size)
        often = np.full(len(size), -1, np.int64)
        order = np.lexsort((-term, tf, row))
        often[row[order]] = term[order]  # the last of a document: its most frequent term
        rank = np.lexsort((size, often))
        place = np.empty(len(size), np.int64)
        place[rank] = np.arange(len(size))
        return Batch(docs.fill_null(0).to_numpy(zero_copy_only=False)[rank], docs.is_null().to_numpy(zero_copy_only=False)[rank], place[row], term, gain(tf, m[row]))


def maxima(x: np.ndarray, width: int) -> np.ndarray:
    return np.maximum.reduceat(x, np.arange(0, len(x), width), axis=0)


def descend(batch: Batch, items: Items, lo: int, hi: int, best: Best, how: Search) -> int:
    """Offers the documents of a batch to the items of a block. How many pairs were scored."""
    term = items.term[items.first[lo] : items.first[hi]]
    both = np.intersect1d(term, batch.term)
    if not len(both):
        return 0
    owner = np.repeat(np.arange(hi - lo), np.diff(items.first[lo : hi + 1]))

    def columns(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, t), len(both) - 1)
        return both[at] == t, at

    w, g = np.zeros((hi - lo, len(both))), np.zeros((len(batch.doc), len(both)))
    here, at = columns(term)
    w[owner[here], at[here]] = items.weight[term[here]]
    here, at = columns(batch.term)
    g[batch.row[here], at[here]] = batch.gain[here]
    leaves = maxima(g, how.leaf)
    groups = maxima(leaves, how.group // how.leaf)
    root = groups.max(axis=0)
    # the root of the documents against groups of items, then against items
    group = maxima(w, how.items)
    least = np.minimum.reduceat(best.least[lo:hi], np.arange(0, hi - lo, how.items))
    alive = np.flatnonzero(np.repeat(group @ root >= least, how.items)[: hi - lo])
    alive = alive[w[alive] @ root >= best.least[lo + alive]]
    if not len(alive):
        return 0
    # groups of documents, then leaves, each only against items that some node above left
    live = w[alive] @ groups.T >= best.least[lo + alive][:, None]
    under = np.flatnonzero(np.repeat(live.any(axis=0), how.group // how.leaf)[: len(leaves)])
    kept = live.any(axis=1)
    alive, live = alive[kept], live[kept]
    bound = w[alive] @ leaves[under].T
    bound[~live[:, under // (how.group // how.leaf)]] = 0
    scored = 0
    for x in np.argsort(-bound.max(axis=0, initial=0)):
        rows = alive[bound[:, x] >= best.least[lo + alive]]
        if not len(rows):
            continue
        docs = np.arange(under[x] * how.leaf, min((under[x] + 1) * how.leaf, len(g)))
        used = np.flatnonzero(leaves[under[x]])
        score = w[np.ix_(rows, used)] @ g[np.ix_(docs, used)].T
        scored += score.size
        for i, d in zip(*np.nonzero(score >= best.least[lo + rows][:, None])):
            best.offer(lo + int(rows[i]), int(score[i, d]), bool(batch.missing[docs[d]]), int(batch.doc[docs[d]]))
    return scored


def nearest(slim: DataFrame, model: Broadcast, how: Search) -> DataFrame:
    """Each task's best documents: (item, item_id, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, total, length = model.value
        best = Best(len(items.name), how.k)
        for whole in batches:
            for at in range(0, whole.num_rows, how.batch):
                part = whole.slice(at, how.batch)
                lists, counts = part.column("terms"), part.column("counts")
                first = lists.offsets.to_numpy()
                m = norm(part.column("n").to_numpy(), total, length)
                batch = Batch.of(part.column("doc_id"), first - first[0], lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64), m)
                for lo in range(0, len(items.name), how.block):
                    descend(batch, items, lo, min(lo + how.block, len(items.name)), best, how)
        rows = [(i, None if not there else -doc, score) for i, heap in enumerate(best.heaps) for score, there, doc in heap]
        if rows:
            item, doc, score = (list(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), items.name.take(pa.array(item)), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "item_id", "doc_id", "score"])

    return slim.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def searched(documents: DataFrame, pairs: DataFrame, how: Search) -> DataFrame:
    """The best documents of the items of one group; ``pairs`` are distinct rows of item and term."""
    sc = documents.sparkSession.sparkContext
    rows = pairs.toArrow().combine_chunks()
    item, term = (rows.column(c).combine_chunks().dictionary_encode("encode") for c in ("item_id", "term"))
    known = sc.broadcast(Vocabulary(term.dictionary.to_pylist()))
    slim = cut(postings(documents, known))
    total, length = slim.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(term.dictionary), np.int64)
    held = slim.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()  # a row a term of the items
    df[held.column("term").to_numpy()] = held.column("n").to_numpy()
    weights = np.array([weight(total, n) for n in df.tolist()], np.int64)
    items = Items.of(item.indices.to_numpy(), item.dictionary, term.indices.to_numpy().astype(np.int64), weights)
    return nearest(slim.where(F.size("terms") > 0), sc.broadcast((items, total, length)), how)


def ranked(documents: DataFrame, items: DataFrame, how: Search = Search()) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item."""
    pairs = cut(items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct())
    n = max(1, -(-pairs.count() // how.max_terms))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = [searched(docs, pairs if n == 1 else pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == g), how) for g in range(n)]
    best = parts[0]
    for more in parts[1:]:
        best = best.union(more)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return best.withColumn("rank", rank).where(F.col("rank") <= how.k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle(k: int = 10) -> str:
    words = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM.replace(chr(92) + 'x00', chr(92) + 'x{0}')}')"
    return f"""with d as materialized (select row_number() over () r, doc_id, {words} t from documents),
s as (select count(*) filter (len(t) > 0) n, sum(len(t))::bigint l from d),
i as materialized (select distinct item_id, unnest({words}) term from benchmark),
tf as materialized (select r, doc_id, len(t)::bigint len, term, count(*)::bigint tf from (select r, doc_id, t, unnest(t) term from d) where term in (select term from i) group by all),
w as (select term, floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)))::bigint w from tf, s group by term, n),
sc as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len * n) // l))))::bigint score from i join tf using (term) join w using (term), s group by all),
rk as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int "rank", doc_id, score from sc where score > 0)
select * from rk where "rank" <= {k}"""


ORACLE = oracle()
