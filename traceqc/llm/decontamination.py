"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

Words are runs of non-blank characters, A-Z lower-cased; shingles are runs of five words, weighted by their inverse
frequency over the benchmark items. A window has as many words as the item it is compared with; a document of fewer
words than the item is one window as a whole. A window's 64-bit SimHash is looked up in an index of the items' fingerprints: eight blocks of eight bits, each searched within Hamming distance 1,
so no fingerprint within distance 15 is missed (a fingerprint that differs by 2 bits or more in each of 8 blocks
differs by 16 at least). Candidates are verified by the exact weighted Jaccard similarity of the shingle multisets.
A window that shares no shingle with an item of its size has similarity 0, so only windows that hold one are
fingerprinted, and of these only such whose shingles of items of their size weigh ``similarity`` of the window, and of the
lightest of these items; this loses nothing. Nor does leaving out a shorter document whose shingles of such items weigh
less than ``similarity`` of the lightest of them.

The items travel to the tasks in groups of about ``max_items`` rows and ``max_bytes`` of text, one pass over the documents for each group.
Frequencies are counted over all items in Spark, and each group weighs by them, so groups change no result. Shingles of
one item weigh the same as unknown ones; only those of two or more are held as a table, 16 bytes each, of at most
``max_shared`` rows (checked).
Documents are read once, whole, in vectorised slices; nothing is shuffled but the verified pairs.

Defined results: null and empty texts match nothing; items of fewer than five words have no shingles and match nothing;
repeated items each match; repeated rows of a document give one pair with the best window; of windows of equal
similarity the first counts; texts of any length are read whole; empty tables give an empty result; extra columns, of
whatever names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceqc.llm import grams
from traceqc.llm.common import table

WIDTH = 5
BLOCKS, REACH, RADIUS = 8, 1, 15
SPAN = 1 << 15  # shingles fingerprinted at once
PAIRS = 1 << 20  # pairs of windows and items looked at at once


@dataclass(frozen=True)
class Search:
    similarity: float = 0.8
    max_items: int = 20_000
    max_bytes: int = 64 << 20
    max_shared: int = 8_000_000  # shingles that two or more items hold


def shingles_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return grams.shingles(grams.words(data, np.array([0, len(data)]), grams.blank_table()), WIDTH)[0]


def near(block: np.ndarray) -> np.ndarray:
    """For 8-bit values, the values within Hamming distance ``REACH`` (1)."""
    return np.concatenate([block[:, None], block[:, None] ^ (1 << np.arange(8))], axis=1)


@dataclass(frozen=True)
class Weights:
    """Integer weights of the shingles that several items hold, in order, and that of all others."""

    shared: np.ndarray
    scaled: np.ndarray
    other: int

    def __call__(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(s), self.other)
        at = np.minimum(np.searchsorted(self.shared, s), len(self.shared) - 1)
        return np.where(self.shared[at] == s, self.scaled[at], self.other)


def weighed(total: int, shingles: np.ndarray, items: np.ndarray) -> Weights:
    """Weights by the number of items, of ``total``, that hold a shingle; one that is not given counts as held by one."""
    order = np.argsort(shingles[items > 1], kind="stable")
    kinds, where = np.unique(items[items > 1][order], return_inverse=True)
    scaled = [round(16 * (1 + math.log(max(1, total) / int(n)))) for n in kinds]
    return Weights(shingles[items > 1][order], np.array(scaled, np.int64)[where], round(16 * (1 + math.log(max(1, total)))))


def weights_of(items: DataFrame, most: int = Search.max_shared) -> Weights:
    """The weights over all items; more than ``most`` shared shingles are an error."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                s = np.unique(shingles_of(text.as_py() or ""))
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.arange(len(s)) == 0)], ["shingle", "head"])

    every = items.select("text").mapInArrow(distinct, "shingle long, head boolean")
    total = every.where("head").count()
    shared = every.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").limit(most + 1).toArrow()
    if shared.num_rows > most:
        raise ValueError(f"the items share more than {most} shingles")
    return weighed(total, shared.column("shingle").to_numpy().view(np.uint64), shared.column("n").to_numpy())


class Items:
    """Fingerprints and shingles of benchmark items, by number of shingles."""

    def __init__(self, rows: list[tuple], search: Search, weights: Weights | None = None):
        self.search = search
        self.rows = [(i, s) for i, t in rows if len(s := shingles_of(t or ""))]
        df = Counter(h for _, s in self.rows for h in set(s.tolist()))
        self.known = np.array(sorted(df), np.uint64)
        if weights is None:
            weights = weighed(len(self.rows), np.array(list(df), np.uint64), np.array(list(df.values()), np.int64))
        self.weight = weights
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.sizes: dict[int, dict] = {}
        by_size = defaultdict(list)
        for k, (_, s) in enumerate(self.rows):
            by_size[len(s)].append(k)
        for size, members in by_size.items():
            prints = np.array([self.prints(self.rows[k][1], np.zeros(1, np.int64), size)[0] for k in members], np.uint64)
            index = []
            for b in range(BLOCKS):
                values = near(((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64))
                order = np.argsort(values.ravel(), kind="stable")
                index.append((np.searchsorted(values.ravel()[order], np.arange(257)), order // values.shape[1]))
            own = np.unique(np.concatenate([self.rows[k][1] for k in members]))
            least = min(int(self.weight(self.rows[k][1]).sum()) for k in members)
            self.sizes[size] = {"members": members, "prints": prints, "index": index, "shingles": own, "least": least}

    def prints(self, s: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """SimHashes of the windows of ``size`` shingles at ``starts``."""
        signs = (((s[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32) * 2 - 1) * self.weight(s)[:, None].astype(np.int32)
        total = np.zeros((len(s) + 1, 64), np.int32)
        np.cumsum(signs, axis=0, out=total[1:])
        bits = (total[starts + size] - total[starts]) > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()

    def candidates(self, prints: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, member) of all pairs within the radius, of so many windows at a time that their blocks hold ``PAIRS``
        pairs (one window at least)."""
        own = self.sizes[size]
        values = [((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64) for b in range(BLOCKS)]
        pairs = np.cumsum(sum(np.diff(heads)[v] for (heads, _), v in zip(own["index"], values)))
        at = 0
        while at < len(prints):
            to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, "right")))
            found = []
            for (heads, members), value in zip(own["index"], values):
                lo, n = heads[value[at:to]], np.diff(heads)[value[at:to]]
                place = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                window, member = np.repeat(np.arange(at, to), n), members[place]
                close = np.bitwise_count(prints[window] ^ own["prints"][member]) <= RADIUS
                found.append(window[close] * len(own["members"]) + member[close])
            both = np.unique(np.concatenate(found))
            yield both // len(own["members"]), both % len(own["members"])
            at = to

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted Jaccard similarity of two shingle multisets."""
        every, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = np.bincount(where[: len(a)], minlength=len(every)), np.bincount(where[len(a) :], minlength=len(every))
        w = self.weight(every)
        return float((np.minimum(x, y) * w).sum() / (np.maximum(x, y) * w).sum())

    def heavy(self, s: np.ndarray, h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Windows whose shingles of items of their size, at the places ``h``, can make up the similarity.

        What a window shares with an item weighs no more than these, and the similarity no more than that over the whole
        window's weight, or over the lightest item's.
        """
        if not len(starts):
            return np.zeros(0, bool)
        out = np.zeros(len(starts), bool)
        known = np.concatenate([[0], np.cumsum(self.weight(s[h]))])
        for at in range(0, len(starts), SPAN):
            part = starts[at : at + SPAN]
            held = known[np.searchsorted(h, part + size)] - known[np.searchsorted(h, part)]
            # shingles of no item of this size weigh ``lightest`` at least
            n_known = np.searchsorted(h, part + size) - np.searchsorted(h, part)
            least = np.maximum(held + (size - n_known) * self.lightest, self.sizes[size]["least"])
            out[at : at + SPAN] = held + 1e-6 >= self.search.similarity * least
        return out

    @property
    def lightest(self) -> int:
        """No shingle weighs less."""
        return int(min(self.weight.scaled.min(initial=self.weight.other), self.weight.other))

    def matches(self, s: np.ndarray, first: np.ndarray) -> dict:
        """(document, item row): best similarity and its start, for the documents of a slice."""
        best: dict = {}
        hits = np.flatnonzero(self.maybe[(s >> np.uint64(44)).astype(np.int64)])
        hits = hits[np.isin(s[hits], self.known)]
        if not len(hits):
            return best
        whole: dict = {}  # SimHashes of whole documents

        def verify(prints: np.ndarray, size: int, starts: np.ndarray, n: int) -> None:
            own = self.sizes[size]
            for windows, members in self.candidates(prints, size):
                for w, m in zip(windows, members):
                    k = own["members"][m]
                    value = self.similarity(s[starts[w] : starts[w] + n], self.rows[k][1])
                    doc = int(np.searchsorted(first, starts[w], "right")) - 1
                    if value >= self.search.similarity and (value, -starts[w]) > best.get((doc, k), (0.0, 0)):
                        best[doc, k] = (value, -starts[w])

        for size, own in self.sizes.items():
            h = hits[np.isin(s[hits], own["shingles"])]
            if not len(h):
                continue
            doc = np.searchsorted(first, h, "right") - 1
            begin, stop = first[doc], first[doc + 1]
            short = stop - begin < size
            held = np.bincount(doc[short], self.weight(s[h[short]]))
            for d in np.flatnonzero((held > 0) & (held + 1e-6 >= self.search.similarity * own["least"])):
                text = s[first[d] : first[d + 1]]
                if d not in whole:
                    whole[d] = self.prints(text, np.zeros(1, np.int64), len(text))
                verify(whole[d], size, first[d : d + 1], len(text))
            lo, hi = np.maximum(h - size + 1, begin), np.minimum(h, stop - size)
            n = np.maximum(hi - lo + 1, 0)
            starts = np.unique(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            starts = starts[self.heavy(s, h, starts, size)]
            at = 0
            while at < len(starts):
                # windows that lie close together share their sums
                near_by = starts[at : at + SPAN]
                far = np.flatnonzero((np.diff(near_by) > 4 * size) | (near_by[1:] - near_by[0] > SPAN))
                group = near_by[: far[0] + 1] if len(far) else near_by
                at += len(group)
                part = s[group[0] : group[-1] + size]
                verify(self.prints(part, group - group[0], size), size, group, size)
        return best


SCHEMA = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame, search: Search = Search(), id_col: str = "doc_id") -> DataFrame:
    """Pairs of documents and items with the best window: its first word, its words, and its similarity."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, math.ceil(n / search.max_items), math.ceil(size / search.max_bytes))
    weights = weights_of(items, search.max_shared)
    sent = docs.sparkSession.sparkContext.broadcast((weights.shared, weights.scaled, weights.other))
    out = None
    for g in range(groups):
        index = Items([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()], search, weights)
        index.weight = None  # sent once for all groups
        found = slim.mapInArrow(scanner(index, sent), SCHEMA)
        out = found if out is None else out.union(found)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), "start_word", "n_words")
    return out.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def scanner(index: Items, weights: Broadcast):
    inside = grams.blank_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index.weight = Weights(*weights.value)
        for batch in batches:
            for part, data, offsets in grams.sliced(batch):
                s, first = grams.shingles(grams.words(data, offsets, inside), WIDTH)
                found = index.matches(s, first)
                ids = part.column("doc_id").to_pylist() if found else []
                rows = [(ids[d], index.rows[k][0], -start - int(first[d]), min(len(index.rows[k][1]), int(first[d + 1] - first[d])) + WIDTH - 1, value) for (d, k), (value, start) in found.items()]
                columns = list(zip(*rows)) or [[]] * 5
                types = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([x if t is types[4] else (None if x is None else int(x)) for x in c], t) for c, t in zip(columns, types)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: All windows that hold a shingle of the item, without fingerprints: the larger weight of two counts is their sum less the
#: smaller one.
ORACLE = r"""
with words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
item_words as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from benchmark),
s as materialized (select doc_id, p, array_to_string(w[p:p+4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) p from words where len(w) > 4)),
i as materialized (select item_id, array_to_string(w[p:p+4], ' ') g from (select item_id, w, unnest(range(1, len(w) - 3)) p from item_words where len(w) > 4)),
held as materialized (select item_id, g, count(*) m from i group by 1, 2),
total as (select count(distinct item_id) t from held),
known as materialized (select g, round(16 * (1 + ln(t / count(*)))) weight from held, total group by g, t),
other as (select round(16 * (1 + ln(greatest(t, 1)))) weight from total),
item as (select item_id, sum(m) n, sum(m * weight) mass from held join known using (g) group by 1),
doc as (select doc_id, count(*) n from s group by 1),
starts as materialized (
  select distinct doc_id, item_id, least(item.n, doc.n) size,
    unnest(case when doc.n < item.n then [1] else range(greatest(1, p - item.n + 1)::bigint, least(p, doc.n - item.n + 1)::bigint + 1) end) start
  from s join held using (g) join item using (item_id) join doc using (doc_id)),
cells as (
  select doc_id, item_id, start, size, s.g, count(*) m from starts join s using (doc_id) where s.p between start and start + size - 1 group by all),
found as (
  select doc_id, item_id, start, size, sum(least(c.m, coalesce(h.m, 0)) * coalesce(k.weight, o.weight)) low, sum(c.m * coalesce(k.weight, o.weight)) mass
  from cells c left join held h using (item_id, g) left join known k using (g) cross join other o group by all)
select doc_id, item_id, (start - 1)::bigint start_word, (size + 4)::bigint n_words, low / (found.mass + item.mass - low) similarity
from found join item using (item_id) where low / (found.mass + item.mass - low) >= 0.8
qualify row_number() over (partition by doc_id, item_id order by low / (found.mass + item.mass - low) desc, start) = 1
"""
