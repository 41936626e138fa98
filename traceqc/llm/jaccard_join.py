"""N-gram Jaccard join in the Jaccard metric space, exact at every size.

A document is its set of hashed shingles; 1 - Jaccard similarity is a metric. Documents of equal sets are one class.

Pivots and regions: almost all documents are about as far from the nearest of some random pivots as from all others (of
9,270 sets, with 64 pivots 99 % at 0.8 or more, so that windows send a document to 63.4 regions; with 512 to 477), so a
pivot only draws those it can matter for. Two sets that link differ in ``d`` shingles at most, which follows from the size
of the smaller one. All shingles are dealt by hash into more than ``d`` parts, the same for all sets of a class of sizes; a
shingle in which the two differ spoils one part, so some part is equal in both, and not empty. What a set holds of a part
is its token. Classes that share too few tokens with any others can't link and drop out. For each shared token the
smallest class that holds it is the pivot, and every holder joins its region; any two classes that link therefore meet in a
region. Of a class's shared tokens only the rarest make regions, as many as are needed for that. A part has some
six shingles, so a passage that many documents hold, which grow in number with the table, gives them no common token,
as single shingles would.

Regions join recursively: a region of more than ``cell`` members picks pivots among them, each member goes to its
nearest pivot, and, by the triangle inequality, also to every pivot at most ``2 * eps`` farther (``eps`` is the link
distance), so no link crosses cells; the cells do the same. Small cells, and cells that no longer shrink, are joined by
exact intersection counts in blocks. A region of more than ``block`` shingles is dealt out in parts, each with the pivot, so
what a task holds is bounded in bytes, however long its documents are. Members that are linked to the pivot within their part need no test among each other; only the others (the outer ones)
are then sent to all parts of their region and tested there. Tasks return spanning forests of links, not all pairs.

Defined results: a null or blank text has the empty set and links with nothing; a text of fewer words than a shingle has
its word sequence as its one shingle; repeated ids give one row for each row; a row without an id
joins its class's component or, where the whole class has none, has none; an empty table gives an empty result;
texts of any length are read whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceqc.llm import grams
from traceqc.llm.common import cut, narrowed, table
from traceqc.llm.components import components


@dataclass(frozen=True)
class Join:
    """Words of a shingle, least similarity in per cent, and sizes of blocks (shingles) and cells (classes)."""

    width: int = 3
    percent: int = 90
    block: int = 1 << 20
    cell: int = 32
    pivots: int = 8
    growth: float = 1.5  # from a class of sizes to the next


def sets_of(w: grams.Words, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each document; of fewer words, the whole sequence as one."""
    s, first = grams.shingles(w, width)
    out = []
    for d in range(len(w.first) - 1):
        n = w.first[d + 1] - w.first[d]
        if n >= width:
            out.append(np.unique(s[first[d] : first[d + 1]]))
        elif n:
            total = np.array([n], np.uint64)
            for h in w.hash[w.first[d] : w.first[d + 1]]:
                total = grams.mix(total * np.uint64(31) + h)
            out.append(total)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def apart(n: int, percent: int) -> int:
    """In how many shingles two sets that link differ at most, of which the smaller has ``n``."""
    return n * (100 - percent) // percent


@cache
def size_classes(percent: int, growth: float) -> list[tuple[int, int, int, int]]:
    """Classes of sizes: first size, end, number of parts, and how many of these may be empty.

    Smaller sets than those of the first class link with equal ones only. A set has some parts without a shingle by chance;
    ``spare`` parts more than needed let most sets have as many.
    """
    out = []
    lo = -(-percent // (100 - percent)) if percent < 100 else LONGEST
    while lo < LONGEST:
        hi = max(lo + 1, int(lo * growth))
        least = apart(hi - 1, percent) + 1
        empty = least * math.exp(-lo / least)
        spare = int(empty + 2 * math.sqrt(empty))
        out.append((lo, hi, least + spare, spare))
        lo = hi
    return out


#: No set is as large; how often a set is dealt out anew if too many of its parts are empty.
LONGEST, TRIES = 1 << 40, 4


def tokens(s: np.ndarray, join: Join) -> list[tuple[int, np.ndarray]]:
    """The tokens of a set of sorted shingles by group, each with the number that it shares with any set it links with.

    A group is a class of sizes and a way to deal. A set belongs to the classes of all sizes that the smaller one of a pair
    with it may have. Where over ``spare`` of its parts are empty, equal parts may be no more than these: such a set is dealt
    out in another way besides, and a pair meets in the first way that leaves one of both few empty parts. In the end,
    empty parts are tokens as well.
    """
    out, n, smallest, ways = [], len(s), (len(s) * join.percent + 99) // 100, []
    for c, (lo, hi, k, spare) in enumerate(size_classes(join.percent, join.growth)):
        if lo > n:
            break
        if hi <= smallest:
            continue
        equal = k - apart(min(n, hi - 1), join.percent)
        for way in range(TRIES):
            if way == len(ways):
                h = s if way == 0 else np.sort(grams.mix(s + np.uint64(way)))
                sums = np.zeros(n + 1, np.uint64)
                ways.append((h, np.cumsum(grams.mix(h), out=sums[1:]), sums))
            h, _, sums = ways[way]
            starts, labels = dealt(k, c * TRIES + way)
            bounds = np.append(h.searchsorted(starts), n)
            total = sums[bounds]
            token, held = grams.mix(total[1:] - total[:-1] + labels), bounds[1:] > bounds[:-1]
            out.append((equal - spare, token[held]))
            if len(out[-1][1]) >= k - spare:
                break
        else:
            out.append((equal, grams.mix(token + np.uint64(1))))
    return out


@cache
def dealt(k: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """The least shingle of each of ``k`` parts, and a label of each part in a group."""
    return np.array([-(-(j << 64) // k) for j in range(k)], np.uint64), grams.mix(np.arange(k, dtype=np.uint64) + np.uint64(group << 40))


def signatures(docs: DataFrame, join: Join, id_col: str) -> DataFrame:
    """(doc_id, n, sig, groups): size, digest of the set (null: empty) and its tokens by group."""
    inside = grams.blank_table()

    def nested(groups: list[list[tuple[int, np.ndarray]]]) -> pa.Array:
        flat = [group for of in groups for group in of]
        held = pa.array(np.concatenate([np.zeros(0, np.uint64), *(t for _, t in flat)]).view(np.int64))
        lists = pa.ListArray.from_arrays(np.cumsum([0, *(len(t) for _, t in flat)], dtype=np.int32), held)
        each = pa.StructArray.from_arrays([pa.array([needed for needed, _ in flat], pa.int32()), lists], ["needed", "tokens"])
        return pa.ListArray.from_arrays(np.cumsum([0, *(len(of) for of in groups)], dtype=np.int32), each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in grams.sliced(batch):
                sets = sets_of(grams.words(data, offsets, inside), join.width)
                sig = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                groups = nested([tokens(s, join) for s in sets])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), groups], ["doc_id", "n", "sig", "groups"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, sig binary, groups array<struct<needed: int, tokens: array<long>>>")


def regions(classes: DataFrame, join: Join) -> DataFrame:
    """(pivot, member, size) for the classes (rep, n, groups) that may link; ``size`` counts the shingles of a region.

    Two classes that link share at least ``needed`` tokens of a group. What has fewer shared ones in a group drops out of it;
    of the others' shared tokens, all but the ``needed - 1`` most frequent ones still hold one that both have, so only
    these rarest ones make regions.

    What concerns one class (no more rows than its tokens) is counted in a window: joins are left only where one token or
    region may have many rows, so few small tables are broadcast and plans stay small on the driver.
    """
    own = Window.partitionBy("rep", "g")
    # counted in a window, so that postings are exchanged once; a frequent token's rows spill, they aren't gathered
    postings = classes.select("rep", F.posexplode("groups").alias("g", "_group")).select("rep", "g", "_group.needed", F.explode("_group.tokens").alias("token"))
    held = cut(postings.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1").drop("df"))
    # without the classes that can't link, more tokens have one holder
    left = held.withColumn("got", F.count("*").over(own)).where("got >= needed").drop("got")
    shared = left.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    held = cut(left.join(shared, "token").select("rep", "g", "needed", "token", "df"))
    rare = held.withColumn("place", F.row_number().over(own.orderBy("df", "token"))).withColumn("got", F.count("*").over(own))
    rare = cut(rare.where("got >= needed and place <= got - needed + 1").select("rep", "token"))
    # a pivot is a holder itself
    pivots = rare.groupBy("token").agg(F.min("rep").alias("pivot"), F.count("*").alias("df")).where("df > 1").select("token", "pivot")
    member = rare.join(pivots, "token").select("pivot", F.col("rep").alias("member")).distinct()
    member = member.join(classes.select(F.col("rep").alias("member"), "n"), "member")
    several = member.groupBy("pivot").agg(F.count("*").alias("members"), F.sum("n").alias("size")).where("members > 1").drop("members")
    return cut(member.drop("n").join(several, "pivot"))


#: Members and shingles that are compared at once.
MEMBERS, SPAN = 1024, 1 << 18


class Cells:
    """The recursive exact join of one region."""

    def __init__(self, sets: list[np.ndarray], join: Join):
        self.join = join
        self.eps = 1 - join.percent / 100
        self.n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        every, where = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.n)
        common = np.bincount(where, minlength=len(every))[where] > 1  # a shingle of one member is in no intersection
        self.first = np.concatenate([[0], np.cumsum(np.bincount(owner[common], minlength=len(sets)))])
        self.token = where[common]
        self.parent = np.arange(len(sets))

    def pieces(self, members: np.ndarray) -> Iterator[np.ndarray]:
        """``members`` in parts of ``MEMBERS`` and about ``SPAN`` shingles at most, one member at least."""
        total = np.cumsum(self.first[members + 1] - self.first[members])
        at = 0
        while at < len(members):
            before = total[at - 1] if at else 0
            to = min(at + MEMBERS, max(at + 1, int(np.searchsorted(total, before + SPAN, "right"))))
            yield members[at:to]
            at = to

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of members a with members b."""
        tokens = [self.token[self.first[k] : self.first[k + 1]] for k in (*a, *b)]
        every, where = np.unique(np.concatenate(tokens), return_inverse=True)
        row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        out = np.zeros((len(a), len(b)), np.float32)
        step = max(1, (1 << 22) // len(tokens))  # shingles at once: 16 MB of cells
        order = np.argsort(where, kind="stable")
        where, row = where[order], row[order]
        for lo in range(0, len(every), step):
            i, j = np.searchsorted(where, [lo, lo + step])
            cells = np.zeros((len(tokens), min(step, len(every) - lo)), np.float32)
            cells[row[i:j], where[i:j] - lo] = 1
            out += cells[: len(a)] @ cells[len(a) :].T
        return np.rint(out).astype(np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unites members a and b that link; each round takes one open link of every member that has any."""
        inter = self.common(a, b)
        linked = 100 * inter >= self.join.percent * (self.n[a][:, None] + self.n[b][None, :] - inter)
        while True:
            left, right = (np.array([self.root(k) for k in x]) for x in (a, b))
            open_ = linked & (left[:, None] != right[None, :])
            rows = np.flatnonzero(open_.any(axis=1))
            if not len(rows):
                return
            for x, y in zip(rows, open_[rows].argmax(axis=1)):
                p, q = self.root(a[x]), self.root(b[y])
                self.parent[max(p, q)] = min(p, q)

    def run(self, members: np.ndarray) -> None:
        if len(members) <= self.join.cell:
            return self.blocks(members)
        # farthest-first pivots, from the first member on
        chosen, distance = [0], None
        while True:
            inter = np.concatenate([self.common(part, members[chosen[-1:]])[:, 0] for part in self.pieces(members)])
            d = 1 - inter / (self.n[members] + self.n[members[chosen[-1]]] - inter)
            distance = d[:, None] if distance is None else np.concatenate([distance, d[:, None]], axis=1)
            far = int(distance.min(axis=1).argmax())
            if len(chosen) == self.join.pivots or distance[far].min() <= 0:
                break
            chosen.append(far)
        near = distance.min(axis=1)
        # a member at distance 1 from every pivot has no link with one that is nearer than 1 - eps
        inside = (distance <= near[:, None] + 2 * self.eps + 1e-9) & (distance < 1)
        cells = [members[inside[:, k]] for k in range(len(chosen))] + [members[near >= 1 - self.eps - 1e-9]]
        if max(len(cell) for cell in cells) >= 0.8 * len(members):
            return self.blocks(members)
        for cell in cells:
            if len(cell) > 1:
                self.run(cell)

    def against(self, some: np.ndarray, members: np.ndarray) -> None:
        for part in self.pieces(some):
            for others in self.pieces(members):
                self.link(part, others)

    def blocks(self, members: np.ndarray) -> None:
        pieces = list(self.pieces(members))
        for k, part in enumerate(pieces):
            for others in pieces[k:]:
                self.link(part, others)


def links(docs: DataFrame, member: DataFrame, join: Join, id_col: str) -> DataFrame:
    """Edges (a, b) between classes that connect all classes that link; a spanning forest of each region."""
    inside = grams.blank_table()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in grams.sliced(batch):
                sets = sets_of(grams.words(data, offsets, inside), join.width)
                yield pa.RecordBatch.from_arrays([part.column("member"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["member", "set"])

    def loaded(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, Cells]:
        """Members in order of id with their outer flags, and their sets."""
        ids = rows.column("member").to_numpy()
        order = np.argsort(ids, kind="stable")
        order = order[np.unique(ids[order], return_index=True)[1]]
        sets = rows.column("set").combine_chunks()
        bounds, flat = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
        outer = rows.column("outer").to_numpy()[order]
        return ids[order], outer, Cells([flat[bounds[k] : bounds[k + 1]] for k in order.tolist()], join)

    def forest(ids: np.ndarray, cells: Cells, home: int | None) -> pa.Table:
        """Edges from members to their roots; with ``home``, members outside its component are marked as outer."""
        roots = np.array([cells.root(k) for k in range(len(ids))])
        far = roots != np.arange(len(ids))
        outer = far & False if home is None else roots != roots[home]
        a, b = np.concatenate([ids[far], ids[outer]]), np.concatenate([ids[roots[far]], ids[outer]])
        return pa.table({"pivot": pa.array(np.full(len(a), -1 if home is None else ids[home])), "a": pa.array(a), "b": pa.array(b)})

    def part(key: tuple, rows: pa.Table) -> pa.Table:
        ids, _, cells = loaded(rows)
        cells.run(np.arange(len(ids)))
        split = key[1].as_py() >= 0
        return forest(ids, cells, int(np.searchsorted(ids, key[0].as_py())) if split else None)

    def across(rows: pa.Table) -> pa.Table:
        ids, outer, cells = loaded(rows)
        cells.against(np.flatnonzero(outer), np.arange(len(ids)))
        return forest(ids, cells, None)

    needed = cut(member.select("member").distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("member"), "text")
    texts = narrowed(texts, needed, "member").join(needed, "member")
    sets = texts.mapInArrow(read, "member long, set array<long>")
    parts = F.ceil(F.col("size") / join.block).cast("int")
    dealt = member.withColumn("parts", parts).withColumn("part", F.when(parts > 1, F.pmod(F.xxhash64("member"), parts)).otherwise(-1).cast("int"))
    # the pivot goes to all parts
    pivots = dealt.where("parts > 1 and pivot = member").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = dealt.where("parts = 1 or pivot <> member").unionByName(pivots)
    found = sets.join(first.select("pivot", "member", "part", F.lit(False).alias("outer")), "member").groupBy("pivot", "part").applyInArrow(part, "pivot long, a long, b long")
    found = cut(found)
    if found.where("a = b").isEmpty():
        return found.select("a", "b").where("a <> b")
    outer = found.where("a = b").select("pivot", F.col("a").alias("member")).distinct()
    large = dealt.where("parts > 1 and pivot <> member")
    moved = large.join(outer, ["pivot", "member"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    stay = large.join(outer, ["pivot", "member"], "left_anti")
    again = stay.withColumn("outer", F.lit(False)).unionByName(moved.withColumn("outer", F.lit(True)))
    rest = sets.join(again.select("pivot", "member", "part", "outer"), "member").groupBy("pivot", "part").applyInArrow(across, "pivot long, a long, b long")
    return found.where("a <> b").unionByName(cut(rest)).select("a", "b")


def joined(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id") -> DataFrame:
    """One row for each document: id, size of its set, and the smallest id that it reaches by links."""
    base = cut(signatures(docs, join, id_col))
    reps = base.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    first = base.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("groups").alias("groups"))
    classes = first.select("rep", "n", "groups")
    edges = links(docs, regions(classes, join), join, id_col)
    linked = components(edges).select(F.col("node").alias("rep"), "component")
    # empty sets join nothing, so they don't meet in one task
    rows = base.where("sig is not null").select("doc_id", "n", "sig").join(reps, "sig").join(linked, "rep", "left")
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return rows.unionByName(base.where("sig is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


def oracle_for(join: Join) -> str:
    """DuckDB SQL for ``joined`` over a table ``documents``."""
    w = join.width
    return rf"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  from documents),
s as materialized (
  select distinct doc_id, case when len(w) < {w} then array_to_string(w, ' ') else array_to_string(w[p:p+{w - 1}], ' ') end g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {w - 2}, 2))) p from w where len(w) > 0)),
n as materialized (select doc_id, count(*) n from s group by 1),
c as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= {join.percent} * (x.n + y.n - i)),
r as (select doc_id a, doc_id b from documents union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, m.c component_id
from documents d left join n on n.doc_id = d.doc_id join (select a, min(b) c from r group by 1) m on m.a = d.doc_id
"""


ORACLE = oracle_for(Join())
