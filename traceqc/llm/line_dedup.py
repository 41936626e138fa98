"""Line deduplication by pairwise alignment of documents that share runs of lines.

Documents of equal texts are one class; only the smallest id of a class takes part, its copies lose all lines. Lines
(trimmed) are hashed.

1. Candidates: what two documents must share is a block (lines that follow each other) of ``block_chars`` characters.
   A block is the union of its shortest runs: for each first line the shortest run that reaches ``block_chars``, and
   for each last line likewise. These runs (two a line at most) are hashed instead of single lines, so a run is rare
   where its lines are not, and no line is too short or too frequent to count. A document is paired with the first
   document that holds one of its runs: a run of n classes makes n - 1 pairs.
2. Alignment: the places of the runs that a pair shares are aligned by patience: those that occur once in the later
   document are anchors, the longest chain of anchors in the order of both documents is kept, and the runs between two
   anchors of the chain that continue it (those that repeat in the later document) join it. Lines outside shared runs are
   in no block, so they take no part and their texts are not moved. What the chain leaves behind (passages in another
   order, or more often in the later document) is aligned again: patience deals it into piles, each of which grows in both
   documents and is a chain of its own.
3. Runs of one chain that lie on one diagonal are one block; a run in no chain is in no block. Blocks of further chains are
   marked as moved.
4. The lines of all blocks go from the later document.

Every block that a document with a smaller id holds goes, whatever the number of holders and the order of blocks.

Defined results: a null text stays null and has no lines; an empty text has one empty line and is never a copy of
another; rows that repeat an id and text are treated alike and never delete each other; a row without an id
loses and deletes nothing; of several places of a run in the earlier document the first counts; an empty table gives an
empty result; texts of any length are compared whole; further columns are kept, but for ``n_lines`` and ``n_removed``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceqc.llm import grams
from traceqc.llm.common import cut, table


@dataclass(frozen=True)
class Limits:
    block_chars: int = 50


def shortest(sizes: np.ndarray, offsets: np.ndarray, block_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, end) of the shortest runs of at least ``block_chars`` from each first and to each last line.

    ``sizes`` are those of all lines; document ``d`` has the lines ``offsets[d]:offsets[d + 1]``.
    """
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(sizes))
    end = np.searchsorted(total, total[at] + block_chars, "left")
    fore = end <= offsets[doc + 1]
    first = np.searchsorted(total, total[at + 1] - block_chars, "right") - 1
    back = first >= offsets[doc]
    # a run found both ways counts once
    back &= ~((first >= 0) & (end[first] == at + 1))
    return np.concatenate([doc[fore], doc[back]]), np.concatenate([at[fore], first[back]]), np.concatenate([end[fore], at[back] + 1])


def hashed(lines: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``first:end`` of ``lines``."""
    up, down = grams.powers(len(lines) + 1)
    total = np.zeros(len(lines) + 1, np.uint64)
    np.cumsum(grams.mix(lines) * up[: len(lines)], out=total[1:])
    return grams.mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.md5("text"))


def line_classes(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, key) of all documents with a text, and the classes of equal texts with their lines."""
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    base = with_key(docs.where(F.length("text") > 0)).select(F.col(id_col).alias("doc_id"), "_key", trimmed.alias("lines"))
    base = cut(base.select("doc_id", "_key", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", lambda x: F.length(x)).alias("sizes")))
    return base.select("doc_id", "_key"), base.groupBy("_key").agg(F.min("doc_id").alias("rep"), F.first("hashes").alias("hashes"), F.first("sizes").alias("sizes"))


def runs_of(classes: DataFrame, block_chars: int) -> DataFrame:
    """(run, rep, class, first, end): the shortest runs of all classes."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = batch.column(2), batch.column(3)
            offsets = np.concatenate([[0], np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            doc, first, end = shortest(sizes.flatten().to_numpy(), offsets, block_chars)
            run = hashed(hashes.flatten().to_numpy().view(np.uint64), first, end).view(np.int64)
            places = [pa.array((x - offsets[doc]).astype(np.int32)) for x in (first, end)]
            taken = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(run), batch.column(0).take(taken), batch.column(1).take(taken), *places], ["run", "rep", "class", "first", "end"])

    kind = classes.schema["rep"].dataType.simpleString()
    return classes.select("rep", "class", "hashes", "sizes").mapInArrow(cut_out, f"run long, rep {kind}, class long, first int, end int")


def longest_chain(at: np.ndarray) -> np.ndarray:
    """The places of a longest strictly growing part of ``at``, by patience sorting."""
    if np.all(at[1:] > at[:-1]):
        return np.arange(len(at))
    tops: list[int] = []
    last: list[int] = []
    before = np.full(len(at), -1)
    for k, x in enumerate(at.tolist()):
        pile = bisect_left(tops, x)
        if pile:
            before[k] = last[pile - 1]
        if pile == len(tops):
            tops.append(x)
            last.append(k)
        else:
            tops[pile], last[pile] = x, k
    out, k = [], last[-1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return np.array(out[::-1])


def chained(first: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For runs of a pair in order of ``first`` (places in the later document) with their places ``held`` in the earlier
    one, whether the alignment keeps them in its chain."""
    kinds, where, times = np.unique(held, return_inverse=True, return_counts=True)
    anchors = np.flatnonzero(times[where] == 1)
    chain = np.zeros(len(first), bool)
    if len(anchors):
        chain[anchors[longest_chain(held[anchors])]] = True
    # between two anchors, and before and after all, what grows from the anchor before stays below the next one
    if not chain.all():
        ahead = np.iinfo(np.int64).max
        limit = np.empty(len(first), np.int64)
        for k in range(len(first) - 1, -1, -1):
            limit[k] = ahead
            if chain[k]:
                ahead = held[k]
        low = -1
        for k in range(len(first)):
            if chain[k] or low < held[k] < limit[k]:
                chain[k], low = True, held[k]
    return chain


def piles(held: np.ndarray) -> np.ndarray:
    """The pile of each place by patience: the one with the largest top below it, a new one where there is none. Each pile
    grows."""
    tops: list[int] = []  # sorted, negated: the largest first
    name: list[int] = []
    out = np.empty(len(held), np.int64)
    for k, x in enumerate(held.tolist()):
        at = bisect_right(tops, -x)
        if at == len(tops):
            tops.append(-x)
            name.append(len(name))
        else:
            # a larger top takes the place of the one it grows from; order among tops stays, as all before are x or more
            tops[at] = -x
        out[k] = name[at]
    return out


def chains(first: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The alignment of a pair's runs: for each the number of its chain. Chain 0 is the patience chain; what it leaves is
    aligned again in piles."""
    number = np.where(chained(first, held), 0, -1)
    rest = np.flatnonzero(number < 0)
    if len(rest):
        number[rest] = 1 + piles(held[rest])
    return number


def blocks_of(first: np.ndarray, end: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, end, held, moved) of the common blocks of a pair, from the alignment of the runs it shares."""
    order = np.lexsort((end, first))
    first, end, held = first[order], end[order], held[order]
    chain = chains(first, held)
    first, end, held, chain = (x[chain >= 0] for x in (first, end, held, chain))
    if not len(first):
        return first, end, held, chain > 0
    # runs of one diagonal and chain that touch or overlap are one block
    diagonal = first - held
    order = np.lexsort((first, diagonal, chain))
    first, end, held, chain, diagonal = (x[order] for x in (first, end, held, chain, diagonal))
    group = np.concatenate([[0], np.cumsum((diagonal[1:] != diagonal[:-1]) | (chain[1:] != chain[:-1]))])
    # ends that reach farthest so far within a group
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    new = np.ones(len(first), bool)
    new[1:] = (group[1:] != group[:-1]) | (first[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    return first[heads], np.maximum.reduceat(end, heads), held[heads], chain[heads] > 0


BLOCKS = "class long, earlier {kind}, first int, end int, earlier_first int, moved boolean"


def aligned(shared: DataFrame, kind: str) -> DataFrame:
    """(class, earlier, first, end, earlier_first, moved): the blocks of each pair, from the runs that it shares."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs").combine_chunks() if isinstance(batch.column("runs"), pa.ChunkedArray) else batch.column("runs")
            bounds = runs.offsets.to_numpy()
            first, end, held = (runs.values.field(name).to_numpy().astype(np.int64) for name in ("first", "end", "held"))
            parts, pair = [], []
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                found = blocks_of(first[a:b], end[a:b], held[a:b])
                parts.append(found)
                pair.append(np.full(len(found[0]), k))
            if not parts:
                continue
            columns = [np.concatenate(x) for x in zip(*parts)]
            at = pa.array(np.concatenate(pair))
            yield pa.RecordBatch.from_arrays(
                [batch.column("class").take(at), batch.column("earlier").take(at), *(pa.array(c.astype(np.int32)) for c in columns[:3]), pa.array(columns[3])],
                ["class", "earlier", "first", "end", "earlier_first", "moved"],
            )

    pairs = shared.groupBy("class", "earlier").agg(F.collect_list(F.struct("first", "end", "held")).alias("runs"))
    return pairs.mapInArrow(align, BLOCKS.format(kind=kind))


def union_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, gone, moved): the places that the blocks of a class cover, and those that only moved ones do."""
    for batch in batches:
        gone, moved = [], []
        for blocks in batch.column(1):
            rows = blocks.values
            first, end = (rows.field(name).to_numpy() for name in ("first", "end"))
            kept = ~rows.field("moved").to_numpy(zero_copy_only=False)
            n = int(end.max()) + 1
            over = lambda x: np.cumsum(np.bincount(first[x], minlength=n) - np.bincount(end[x], minlength=n)) > 0
            every = over(np.ones(len(first), bool))
            gone.append(np.flatnonzero(every).astype(np.int32))
            moved.append(int((every & ~over(kept)).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32())), pa.array(moved, pa.int64())], ["class", "gone", "moved"])


def alignments(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id") -> DataFrame:
    """(later, earlier, first, end, earlier_first, moved): all aligned blocks, by their places in both documents."""
    _, classes = line_classes(docs, id_col)
    blocks, classes = pair_blocks(classes, limits)
    return blocks.join(classes.select("class", F.col("rep").alias("later")), "class").select("later", "earlier", "first", "end", "earlier_first", "moved")


def pair_blocks(classes: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """The blocks of all pairs of classes, and the classes with their numbers."""
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    kind = classes.schema["rep"].dataType.simpleString()
    runs = runs_of(classes, limits.block_chars)
    holder = F.min(F.struct("rep", "first"))
    held = runs.groupBy("run").agg(holder.alias("holder"), F.max("rep").alias("last")).where("holder.rep < last")
    held = held.select("run", F.col("holder.rep").alias("earlier"), F.col("holder.first").alias("held"))
    return aligned(runs.join(held, "run").where("earlier < rep"), kind), classes


def removals(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id") -> DataFrame:
    """(id, key, gone, moved) of the documents that lose lines; ``gone`` holds the places, null: all lines; ``moved`` is
    the number of those that only blocks in another order hold."""
    every, classes = line_classes(docs, id_col)
    blocks, classes = pair_blocks(classes, limits)
    found = blocks.groupBy("class").agg(F.collect_list(F.struct("first", "end", "moved")).alias("blocks")).mapInArrow(union_of, "class long, gone array<int>, moved long")
    whole = F.aggregate("sizes", F.lit(0), lambda a, x: a + x) >= limits.block_chars
    decided = classes.select("_key", "rep", "class", whole.alias("whole")).join(found, "class", "left").drop("class").where("gone is not null or whole")
    copies = every.join(decided, "_key")
    first = copies.where("doc_id = rep and gone is not null").select("doc_id", "_key", "gone", "moved")
    other = copies.where("doc_id <> rep and whole").select("doc_id", "_key", F.lit(None).cast("array<int>").alias("gone"), F.lit(0).cast("long").alias("moved"))
    partly = copies.where("doc_id <> rep and not whole and gone is not null").select("doc_id", "_key", "gone", "moved")
    return first.union(other).union(partly).dropDuplicates(["doc_id", "_key"])


def deduplicated(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id") -> DataFrame:
    """``docs`` with deleted lines taken out of ``text``, and the counts ``n_lines`` and ``n_removed``."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # columns of names that are used here are kept aside
    aside = {c: f"_kept_{c}" for c in columns if c in ("_key", "gone", "_hit")}
    gone = removals(docs.select(id_col, "text"), limits, id_col).drop("moved").withColumnRenamed("doc_id", id_col).withColumn("_hit", F.lit(True))
    rows = with_key(docs.select(*columns).withColumnsRenamed(aside)).join(gone, [id_col, "_key"], "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, k: ~F.array_contains("gone", k)), "\n")
    text = F.when(F.col("_hit").isNull(), F.col("text")).when(F.col("gone").isNull(), F.lit("")).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    n_removed = F.when(F.col("_hit").isNull(), 0).when(F.col("gone").isNull(), n_lines).otherwise(F.size("gone"))
    out = [text.alias(c) if c == "text" else F.col(aside.get(c, c)).alias(c) for c in columns]
    return rows.select(*out, n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


#: The lines that go are those of all shortest runs that a smaller id holds, which needs no alignment.
ORACLE = """
with d as (
  select doc_id, text, string_split(text, chr(10)) raw, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) l
  from documents where text is not null and text <> ''),
r as (select text, min(doc_id) rep from d group by 1),
c as (select rep id, l from r join d on d.doc_id = r.rep and d.text = r.text),
x as (
  select id, p, length(s) n, sum(length(s)) over (partition by id order by p) cum
  from (select id, unnest(range(1, len(l) + 1)) p, unnest(l) s from c)),
f as (select a.id, a.p, min(b.p) e from x a join x b on a.id = b.id and b.p >= a.p and b.cum - a.cum + a.n >= 50 group by 1, 2),
b as (select b.id, max(a.p) p, b.p e from x a join x b on a.id = b.id and b.p >= a.p and b.cum - a.cum + a.n >= 50 group by b.id, b.p),
k as (
  select id, p, e, min(id) over (partition by array_to_string(l[p:e], chr(10))) low
  from (select * from f union select * from b) join c using (id)),
g as (select id, list(distinct q) q from (select id, unnest(range(p, e + 1)) q from k where low < id) group by 1),
v as (
  select d.doc_id, raw, q, doc_id <> rep and list_sum(list_transform(l, lambda s: length(s))) >= 50 whole
  from d join r using (text) left join g on g.id = rep)
select o.doc_id, case when o.text is null then 0 else coalesce(len(raw), 1) end::bigint n_lines,
  case when whole then len(raw) else coalesce(len(q), 0) end::bigint n_removed,
  case when whole then '' when q is null then o.text else array_to_string(list_filter(raw, lambda s, i: not list_contains(q, i)), chr(10)) end text
from documents o left join v using (doc_id)
"""
