"""Exact-substring deduplication by blockwise suffix sorting with difference-cover ranks.

Every byte covered by a string of ``length`` bytes that also starts elsewhere in the corpus is removed. Texts are UTF-8
bytes; strings never cross documents; equal texts are one class, of which one copy takes part.

1. Suffixes are dealt into buckets by content: the bucket of the suffix at ``p`` is the smallest hash among the
   ``length / 2``-byte strings that start in its first half. Equal strings of ``length`` bytes share it and its place, so
   they meet in one bucket whatever document they are in. Buckets that hold one suffix run are dropped at once; for the
   others only the bytes that their suffixes cover are shipped.
2. One block of buckets is sorted at a time, in bounded memory. Suffixes are grouped by bucket, place and their first and
   last bytes. Long ties are resolved by ranks precomputed for the sample positions of a difference cover modulo ``COVER``:
   the samples are sorted by their first ``COVER`` bytes, and as a sample and the position ``COVER`` later are both
   samples, ranks of twice and four times that depth follow by doubling. For any two positions i and j the cover has a
   shift below ``COVER`` that takes both to samples, and equal ranks there say that the ``DEPTH`` bytes from these on are
   equal; the first ``COVER`` bytes and those behind ``DEPTH`` are compared themselves, so the whole strings are.
3. A bucket that more than ``most_holders`` texts share (a passage that a large part of the corpus holds) would be a block
   too large to sort. Its strings are told apart by two hashes of 64 bits instead and counted; strings that a
   slice of texts repeats are merged before, and rows of one string spill, so no task gathers them.
4. Ranges of removed bytes come back to their documents and are merged there.

Runs of suffixes that cover the same bytes (copies of a passage, periodic text) are merged within tasks before
anything is shuffled.

Defined results: a null or empty text has no bytes and keeps none; texts shorter than ``length`` keep all; repeated rows
are copies of each other; rows may lack an id; an empty table gives an empty result; texts of any length are read whole; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from traceqc.llm import grams
from traceqc.llm.common import cut, narrowed, table

#: A perfect difference set modulo 31: every other residue is the difference of exactly one pair.
COVER, RESIDUES = 31, [1, 5, 11, 24, 25, 27]

#: Stands for a missing id between steps, where ids always go with the digest of their text.
NO_ID = -(1 << 63)

U = np.uint64


@dataclass(frozen=True)
class Dedup:
    length: int = 200
    block_bytes: int = 4 << 20  # of shipped bytes sorted at once, about
    most_holders: int = 4096  # texts of a bucket that is sorted


def shifts() -> np.ndarray:
    """For residues i and j modulo ``COVER``, the shift that takes both into the cover."""
    inside = np.isin(np.arange(COVER), RESIDUES)
    k = np.arange(COVER)
    both = inside[(k[:, None, None] + k[None, None, :]) % COVER] & inside[(k[None, :, None] + k[None, None, :]) % COVER]
    return both.argmax(axis=2)


class Hashes:
    """Hashes of substrings of a buffer in constant time each."""

    def __init__(self, data: np.ndarray):
        up, self.down = grams.powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return grams.mix((self.total[start + length] - self.total[start]) * self.down[start])


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one bucket: (document, bucket, first suffix, suffixes, place of the bucket string)."""
    half = length // 2
    width = length - half + 1  # bucket strings that start in a suffix's first part
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(U), none, none, none
    hashes = Hashes(data)
    every = hashes.of(np.arange(len(data) - half + 1), half)
    bits = U(max(22, len(data).bit_length()))
    low = (U(1) << bits) - U(1)
    packed = (every & ~low) | np.arange(len(every), dtype=U)  # ties go to the leftmost
    n = -(-len(packed) // width) * width + width
    padded = np.full(n, ~U(0), U)
    padded[: len(packed)] = packed
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    suffixes = len(data) - length + 1
    at = (np.minimum(right[:suffixes], left[width - 1 : width - 1 + suffixes]) & low).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int64)
    long = offsets[1:] - offsets[:-1] >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    whole = np.cumsum(valid)[:suffixes] > 0  # suffixes that stay within their document
    fresh = whole.copy()
    fresh[1:] &= ~whole[:-1] | (at[1:] != at[:-1])
    fresh[offsets[:-1][long]] = True
    start = np.flatnonzero(fresh)
    stop = whole & np.append(fresh[1:] | ~whole[1:], True)
    count = np.flatnonzero(stop) + 1 - start
    place = at[start]
    return np.searchsorted(offsets, start, "right") - 1, every[place], start, count, place


def depth_of(length: int) -> int:
    """How many bytes ranks of samples compare: as many times ``COVER`` as leave no less than that of the string."""
    return (length - COVER) // COVER * COVER


def eight_bytes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that orders as they do; beyond the end they are 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[at]).view(">u8").ravel().astype(U)


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of tuples of keys, equal for equal ones."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sample_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the cover the rank of its ``depth`` bytes in byte order, -1 for other places and too near the end.
    Strings so short that their ends are all of them (``depth`` 0) need none."""
    if not depth:
        return np.zeros(len(data) + 1, np.int64)
    out = np.full(len(data) + 1, -1)
    grid = np.arange(max(0, len(data) - depth + 1))
    at = grid[np.isin(grid % COVER, RESIDUES)]
    if not len(at):
        return out
    every = np.arange(len(data) - COVER + 1)
    every = every[np.isin(every % COVER, RESIDUES)]
    words = [eight_bytes(data, every + k) for k in range(0, COVER, 8)]
    words[-1] >>= U(8 * (8 * len(words) - COVER))
    first = np.full(len(data) + 1, 0)
    first[every] = dense(*words)
    # ranks of the first d bytes of all samples that have so many, by doubling; what is left over is put together from those
    ranks, d, place = {COVER: first}, COVER, every
    while 2 * d <= depth:
        place = place[place + 2 * d <= len(data)]
        wider = np.full(len(data) + 1, 0)
        wider[place] = dense(ranks[d][place].astype(U) << U(32) | ranks[d][place + d].astype(U))
        d *= 2
        ranks[d] = wider
    rank, done = ranks[d][at], d
    while done < depth:
        d = max(x for x in ranks if done + x <= depth)
        rank = dense(rank.astype(U) << U(32) | ranks[d][at + done].astype(U))
        done += d
    out[at] = rank
    return out


def equal_suffixes(data: np.ndarray, bucket: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """For runs of suffixes laid out in ``data``, which of their suffixes start a string that another one starts too.

    ``first`` and ``place`` are positions in ``data``; the result has one flag for each suffix, run by run.
    """
    run = np.repeat(np.arange(len(first)), count)
    p = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    found = np.zeros(len(run), bool)
    if not len(run):
        return found
    hashes, depth = Hashes(data), depth_of(length)
    tied = grams.mix(bucket[run] + (place[run] - p).astype(U) * U(0x9E3779B97F4A7C15)) ^ hashes.of(p, COVER)
    tied = grams.mix(tied) ^ hashes.of(p + depth, length - depth)
    rank, shift = sample_ranks(data, depth), shifts()
    todo = np.argsort(tied, kind="stable")
    key = tied[todo]
    while len(todo):
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        todo, key, group = todo[several], key[several], group[several]
        if not len(todo):
            break
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        head = todo[np.flatnonzero(new)[np.cumsum(new) - 1]]
        x = shift[p[todo] % COVER, p[head] % COVER]
        same = rank[p[todo] + x] == rank[p[head] + x]
        partner = same & ~new
        pairs = np.flatnonzero(partner)
        a, b = p[todo[pairs]], p[head[pairs]]
        partner[pairs] = equal_bytes(data, a, b, COVER) & equal_bytes(data, a + depth, b + depth, length - depth)
        same &= partner | new
        found[todo[partner]] = True
        found[head[partner]] = True
        todo, key = todo[~same], key[~same]
    return found


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, most: int = 1 << 16) -> np.ndarray:
    """Whether the strings of ``length`` bytes at ``a`` and ``b`` are equal, some at a time."""
    out = np.ones(len(a), bool)
    view = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else None
    for k in range(0, len(a), most):
        out[k : k + most] = (view[a[k : k + most]] == view[b[k : k + most]]).all(axis=1)
    return out


def ranges(flags: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of stretches of set flags that stay in one run."""
    fresh, last = flags.copy(), flags.copy()
    fresh[1:] &= ~flags[:-1] | (run[1:] != run[:-1])
    last[:-1] &= ~flags[1:] | (run[1:] != run[:-1])
    return np.flatnonzero(fresh), np.flatnonzero(last) + 1


def bucket_rows(texts: DataFrame, dedup: Dedup) -> DataFrame:
    """(bucket, class, twice): the buckets of each text, and whether it has more than one run in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in grams.sliced(batch):
                doc, bucket, *_ = runs(data, offsets, dedup.length)
                order = np.lexsort((bucket, doc))
                doc, bucket = doc[order], bucket[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
                heads = np.flatnonzero(new)
                twice = np.diff(np.append(heads, len(doc))) > 1
                ids = part.column("class").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(bucket[heads].view(np.int64)), pa.array(ids[doc[heads]]), pa.array(twice)], ["bucket", "class", "twice"])

    return texts.mapInArrow(run, "bucket long, class long, twice boolean")


def held_runs(part: pa.RecordBatch, column: str, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Which runs are in the buckets that ``column`` lists for their text."""
    shared = part.column(column)
    bounds, flat = shared.offsets.to_numpy(), shared.values.to_numpy()
    take = np.zeros(len(doc), bool)
    edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
    for d in range(part.num_rows):
        mine = slice(edge[d], edge[d + 1])
        take[mine] = np.isin(bucket[mine], flat[bounds[d] : bounds[d + 1]])
    return take


SHIPPED = "block int, doc long, start long, bucket long, n int, place int, certain boolean, body binary"


def shipped_runs(texts: DataFrame, dedup: Dedup, blocks: int) -> DataFrame:
    """The bytes of runs in shared buckets, one row for runs that cover the same bytes in the same way.

    Such runs are known to repeat each other: their ranges go as rows without bytes, and the one that is shipped is
    marked as certain.
    """
    length = dedup.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in grams.sliced(batch):
                doc, bucket, start, count, place = runs(data, offsets, length)
                signed = bucket.view(np.int64)
                take = held_runs(part, "buckets", doc, signed)
                doc, bucket, start, count, place = (x[take] for x in (doc, bucket, start, count, place))
                if not len(doc):
                    continue
                whole = Hashes(data).of(start, count + length - 1) ^ grams.mix(bucket + (place - start).astype(U))
                _, head, back, times = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                ids = part.column("doc_id").to_numpy()
                begin = start - offsets[doc]
                body = [data[a : a + n + length - 1].tobytes() for a, n in zip(start[head], count[head])]
                # equal hashes count only for equal bytes
                alike = np.array([data[a : a + n + length - 1].tobytes() == body[k] if times[k] > 1 else True for a, n, k in zip(start, count, back)])
                if not alike.all():
                    raise ValueError("two runs of different bytes have one hash of 64 bits")
                known = np.flatnonzero(times[back] > 1)
                nulls = pa.nulls(len(known), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([(bucket[head] >> U(20)) % U(blocks), ids[doc[known]].astype(U) % U(blocks)]).astype(np.int32)),
                        pa.array(np.concatenate([ids[doc[head]], ids[doc[known]]])),
                        pa.array(np.concatenate([begin[head], begin[known]])),
                        pa.array(np.concatenate([signed[take][head], signed[take][known]])),
                        pa.array(np.concatenate([count[head], count[known]]).astype(np.int32)),
                        pa.array(np.concatenate([(place - start)[head], (place - start)[known]]).astype(np.int32)),
                        pa.array(np.concatenate([times > 1, np.ones(len(known), bool)])),
                        pa.concat_arrays([pa.array(body, pa.binary()), nulls]),
                    ],
                    [x.split()[0] for x in SHIPPED.split(", ")],
                )
    return texts.mapInArrow(run, SHIPPED)


def sort_block(length: int):
    def block(rows: pa.Table) -> pa.Table:
        number = lambda c: rows.column(c).to_numpy()
        doc, start, bucket, n, place, certain = (number(c) for c in ("doc", "start", "bucket", "n", "place", "certain"))
        sent = rows.column("body").is_valid().to_numpy()
        data, offsets = grams.buffers(rows.column("body").combine_chunks())
        first = offsets[:-1][sent]
        found = equal_suffixes(data, bucket[sent].view(U), first, n[sent].astype(np.int64), first + place[sent], length)
        run = np.repeat(np.arange(len(first)), n[sent])
        found |= certain[sent][run]
        a, b = ranges(found, run)
        base = np.cumsum(n[sent]) - n[sent]
        owner = run[a] if len(a) else np.zeros(0, np.int64)
        lo = start[sent][owner] + a - base[owner]
        hi = start[sent][owner] + b - 1 - base[owner] + length
        return pa.table(
            {
                "doc": pa.array(np.concatenate([doc[sent][owner], doc[~sent]]), pa.int64()),
                "lo": pa.array(np.concatenate([lo, start[~sent]]), pa.int64()),
                "hi": pa.array(np.concatenate([hi, start[~sent] + n[~sent] - 1 + length]), pa.int64()),
            }
        )

    return block


def hot_spans(texts: DataFrame, dedup: Dedup) -> DataFrame:
    """(doc, lo, hi): the repeated strings of the buckets that too many texts hold, by counts of hashes."""
    length, half = dedup.length, dedup.length // 2

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in grams.sliced(batch):
                doc, bucket, start, count, _ = runs(data, offsets, length)
                take = held_runs(part, "hot", doc, bucket.view(np.int64))
                doc, start, count = doc[take], start[take], count[take]
                if not len(doc):
                    continue
                run = np.repeat(np.arange(len(start)), count)
                at = start[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
                hashes = Hashes(data)
                one, two = hashes.of(at, length), grams.mix(hashes.of(at, half) * U(0x9E3779B97F4A7C15) + hashes.of(at + half, length - half))
                pair, head, back, times = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
                # strings that repeat within the slice are known; one of each tells the others
                a, b = ranges(times[back.ravel()] > 1, run)
                ids = part.column("doc_id").to_numpy()
                local = at - offsets[doc[run]]
                n = len(a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(pair[:, 0].view(np.int64)), pa.nulls(n, pa.int64())]),
                        pa.concat_arrays([pa.array(pair[:, 1].view(np.int64)), pa.nulls(n, pa.int64())]),
                        pa.array(np.concatenate([ids[doc[run[head]]], ids[doc[run[a]]] if n else a])),
                        pa.array(np.concatenate([local[head], local[a] if n else a])),
                        pa.array(np.concatenate([local[head] + length, local[b - 1] + length if n else b])),
                    ],
                    ["one", "two", "doc", "lo", "hi"],
                )

    found = cut(texts.where(F.size("hot") > 0).mapInArrow(strings, "one long, two long, doc long, lo long, hi long"))
    # a string stands once for each slice that holds it; what many slices share spills, it isn't gathered
    times = F.count("*").over(Window.partitionBy("one", "two"))
    single = found.where("one is not null").withColumn("times", times).where("times > 1")
    return single.select("doc", "lo", "hi").unionByName(found.where("one is null").select("doc", "lo", "hi"))


def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the ranges of each document and digests what remains of its text."""
    for batch in batches:
        for part, data, offsets in grams.sliced(batch):
            out = []
            for d, spans in enumerate(part.column("spans").to_pylist()):
                text = data[offsets[d] : offsets[d + 1]]
                keep = np.ones(len(text) + 1, bool)
                for s in spans:
                    keep[s["lo"] : s["hi"]] = False
                gone = ~keep[:-1]
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                out.append((int(gone.sum()), n_spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            n, k, sha = zip(*out)
            yield pa.RecordBatch.from_arrays([part.column("sha"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(sha)], ["sha", "n_removed", "n_spans", "kept_sha256"])


def removed(docs: DataFrame, dedup: Dedup = Dedup(), id_col: str = "doc_id") -> DataFrame:
    """One row for each document: bytes, removed bytes, removed runs and the digest of what remains."""
    own = docs.select(F.col(id_col).cast("long").alias("own"), F.coalesce("text", F.lit("")).alias("text"))
    texts = own.withColumn("doc_id", F.coalesce("own", F.lit(NO_ID)))
    base = cut(texts.select("own", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    classes = base.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"))
    long = texts.where(F.octet_length("text") >= dedup.length)
    signed = long.withColumn("sha", F.sha2("text", 256))
    rows = bucket_rows(signed.select("text", F.xxhash64("sha").alias("class")), dedup)
    same = Window.partitionBy("bucket")
    rows = rows.withColumn("shared", (F.min("class").over(same) != F.max("class").over(same)) | F.max("twice").over(same))
    rows = rows.withColumn("many", F.count("*").over(same) > dedup.most_holders).where("shared")
    rows = rows.groupBy("class").agg(F.collect_set(F.when(~F.col("many"), F.col("bucket"))).alias("buckets"), F.collect_set(F.when(F.col("many"), F.col("bucket"))).alias("hot"))
    # of each class, one copy: that of its smallest id
    held = classes.select(F.xxhash64("sha").alias("class"), "rep", "sha")
    wanted = cut(rows.join(held, "class").select(F.col("rep").alias("doc_id"), "sha", "buckets", "hot"))
    total = wanted.agg(F.sum(F.size("buckets"))).first()[0] or 0
    blocks = max(1, total * (dedup.length + dedup.length // 3) // dedup.block_bytes)
    chosen = narrowed(signed, wanted, "doc_id").join(wanted, ["doc_id", "sha"]).dropDuplicates(["sha"])
    chosen = chosen.select(F.xxhash64("sha").alias("doc_id"), "text", "buckets", "hot")
    spans = shipped_runs(chosen, dedup, int(blocks)).groupBy("block").applyInArrow(sort_block(dedup.length), "doc long, lo long, hi long")
    if wanted.where(F.size("hot") > 0).limit(1).count():
        spans = spans.unionByName(hot_spans(chosen, dedup))
    spans = spans.groupBy(F.col("doc").alias("class")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    hit = cut(spans.join(classes.where("copies = 1").select(F.xxhash64("sha").alias("class"), F.col("rep").alias("doc_id"), "sha"), "class").drop("class"))
    done = narrowed(signed, hit, "doc_id").join(hit, ["doc_id", "sha"]).mapInArrow(cleaned, "sha string, n_removed long, n_spans long, kept_sha256 string")
    result = classes.join(done, "sha", "left")
    full = (F.col("copies") > 1) & (F.col("n_bytes") >= dedup.length)
    result = result.select(
        "sha",
        F.when(full, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(full, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(full, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    return base.join(result, "sha").select(F.col("own").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


#: All strings of 200 bytes by digest; removed runs by gaps between their starts. Bytes are pairs of hexadecimal digits.
ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, '')))::bigint n from documents),
p as (select doc_id, s, md5(substr(h, 2 * s + 1, 400)) g from (select doc_id, h, unnest(range(0, n - 199)) s from d where n >= 200)),
r as (select doc_id, s from p qualify count(*) over (partition by g) > 1),
i as (select *, sum(fresh) over (partition by doc_id order by s) island from (select *, (s > coalesce(lag(s) over (partition by doc_id order by s), -1000) + 200)::int fresh from r)),
spans as (select doc_id, min(s) lo, max(s) + 200 hi from i group by doc_id, island),
pieces as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) before_ from spans),
kept as (
  select doc_id, sum(hi - lo)::bigint n_removed, count(*) n_spans, string_agg(substr(h, 2 * before_ + 1, 2 * (lo - before_)), '' order by lo) || substr(any_value(h), 2 * max(hi) + 1) rest
  from pieces join d using (doc_id) group by 1)
select doc_id, n n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(rest, h))) kept_sha256
from d left join kept using (doc_id)
"""
