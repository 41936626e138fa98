"""Centroid clustering (Lloyd's rounds) with heap-ordered bounds.

Vectors are packed into blocks, and the blocks into buckets of a table that is written once. Beside it stands a slim
table of the same buckets: for each block and cluster a heap of the vectors' gaps. The gap of a vector is the lower bound
of its distance to any other centroid less the upper bound of the distance to its own; it is kept offset by the drift that its
cluster had accumulated when it was measured (own movement plus the largest movement of another centroid, summed over
rounds). A round pops the vectors whose offset gap the drift has reached, scans these exactly, and puts them back; all
others provably keep their cluster. Heaps are sorted arrays, so what is popped is a prefix. Centroids follow from exact
integer sums that only moved vectors change.

Each round joins the two tables bucket by bucket, without exchange, and writes the slim one (12 bytes a vector); what
comes to the driver is counts and sums of ``k`` centroids. A lost executor costs the tasks it ran: each round starts from
tables in the shared folder.

Defined results: vectors that are null, of another number of components, or with a component that is null or not finite
are left out; so are those of which a component times ``scale`` is 2 ** 26 or more, in absolute value, by an error (their
squared distances would not fit 64 bits). Repeated rows count each. Vectors without an id are clustered, but are the
last to be starting centroids. Fewer than ``k`` vectors give as many centroids; an empty table gives an empty result.
Equal vectors as starting centroids are possible; the smaller number then takes all. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceqc.functions.lineage import bucketed, forgotten
from traceqc.llm.common import cut, table

LIMIT = 1 << 26
#: Gaps are kept as doubles; one that is smaller than this counts as expired.
SLACK = 1e-6


@dataclass(frozen=True)
class Lloyd:
    """``k`` centroids, ``rounds`` of assignment and replacement; ``block`` vectors a row, ``bucket`` vectors a file."""

    k: int = 8
    rounds: int = 10
    components: int = 64
    scale: int = 1024
    seed: str = "3:"
    block: int = 1024
    bucket: int = 1 << 19


@dataclass
class Centres:
    """Centroids with their accumulated drift, and the exact sums behind them."""

    at: np.ndarray
    drift: np.ndarray
    count: list[int] = field(default_factory=list)
    total: list[list[int]] = field(default_factory=list)

    def moved(self) -> bool:
        """Replaces every centroid that has vectors by their floored mean; whether any of them moved."""
        new = np.array([[s // n for s in t] if n else old for n, t, old in zip(self.count, self.total, self.at.tolist())], np.int64).reshape(self.at.shape)
        way = np.sqrt(((new - self.at).astype(float) ** 2).sum(axis=1))
        self.at = new
        others = np.array([max(np.delete(way, j), default=0.0) for j in range(len(way))])
        self.drift = self.drift + way + others
        return bool(way.any())


def whole(embedding: Column, how: Lloyd) -> Column:
    """The vector in integers, null where it doesn't count."""
    good = (F.size(embedding) == how.components) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.when(good, F.transform(embedding, lambda x: F.floor(x.cast("double") * how.scale)))


def blocks(vectors: DataFrame, how: Lloyd) -> DataFrame:
    """(block, ids, data): up to ``how.block`` vectors a row, one component after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, how.block):
                part = batch.slice(at, how.block)
                values = part.column(1).flatten().to_numpy()
                if values.size and max(values.max(), -values.min()) >= LIMIT:
                    raise ValueError(f"a component times {how.scale} is {LIMIT} or more")
                ids = pa.ListArray.from_arrays([0, part.num_rows], part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([n]), ids, pa.array([values.astype(np.int32).tobytes()], pa.binary())], ["block", "ids", "data"])
                n += 1

    return vectors.select("vec_id", "v").mapInArrow(run, "block long, ids array<long>, data binary")


def distances(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of the vectors to every centroid, exact."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in at], axis=1)


@dataclass
class Heaps:
    """For each cluster the places of its vectors in the block and their offset gaps, smallest first."""

    place: list[np.ndarray]
    gap: list[np.ndarray]

    @staticmethod
    def read(bounds: list[int], place: bytes, gap: bytes) -> Heaps:
        p, g = np.frombuffer(place, np.int32), np.frombuffer(gap, np.float64)
        return Heaps([p[a:b] for a, b in zip(bounds, bounds[1:])], [g[a:b] for a, b in zip(bounds, bounds[1:])])

    def columns(self) -> tuple[list[int], bytes, bytes]:
        return [0, *np.cumsum([len(p) for p in self.place]).tolist()], np.concatenate(self.place).astype(np.int32).tobytes(), np.concatenate(self.gap).tobytes()

    def popped(self, drift: np.ndarray) -> list[np.ndarray]:
        """Takes from each heap the vectors whose gap has expired."""
        out = []
        for j, d in enumerate(drift):
            n = int(np.searchsorted(self.gap[j], d + SLACK, "right"))
            out.append(self.place[j][:n])
            self.place[j], self.gap[j] = self.place[j][n:], self.gap[j][n:]
        return out

    def put(self, j: int, place: np.ndarray, gap: np.ndarray) -> None:
        order = np.argsort(gap, kind="stable")
        at = np.searchsorted(self.gap[j], gap[order])
        self.place[j], self.gap[j] = np.insert(self.place[j], at, place[order]), np.insert(self.gap[j], at, gap[order])


def scanned(heaps: Heaps, data: np.ndarray, centres: Centres, expired: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Puts the expired vectors into the heaps of their nearest centroids. For each cluster the change of its count and
    of its sums, and how many vectors moved. ``expired`` may have one more entry than clusters: vectors without one."""
    k = len(centres.at)
    change, moved = np.zeros((k, 1 + data.shape[1]), np.int64), 0
    who, was = np.concatenate(expired).astype(np.int64), np.repeat(np.arange(len(expired)), [len(e) for e in expired])
    if not len(who):
        return change, moved
    x = data[who].astype(np.int64)
    d = distances(x, centres.at)
    now = d.argmin(axis=1)  # the first of equals
    own = np.sqrt(d[np.arange(len(who)), now].astype(float))
    d[np.arange(len(who)), now] = np.iinfo(np.int64).max
    gap = (np.sqrt(d.min(axis=1).astype(float)) if k > 1 else np.full(len(who), math.inf)) - own + centres.drift[now]
    for j in range(k):
        here = now == j
        if here.any():
            heaps.put(j, who[here], gap[here])
        came, went = here & (was != j), (was == j) & ~here
        change[j, 0] = came.sum() - went.sum()
        change[j, 1:] = x[came].sum(axis=0) - x[went].sum(axis=0)
        moved += int(came.sum())
    return change, moved


def stepped(block: dict, centres: Centres, how: Lloyd) -> tuple[Heaps, np.ndarray, np.ndarray, int, int]:
    """One assignment of a block: its heaps, its vectors, what changes in the sums, and how many were scanned and moved."""
    data = np.frombuffer(block["data"], np.int32).reshape(-1, how.components)
    k = len(centres.at)
    if block.get("gap") is None:
        heaps = Heaps([np.zeros(0, np.int32)] * k, [np.zeros(0)] * k)
        expired = [*[np.zeros(0, np.int32)] * k, np.arange(len(data), dtype=np.int32)]
    else:
        heaps = Heaps.read(block["bounds"], block["place"], block["gap"])
        expired = heaps.popped(centres.drift)
    change, moved = scanned(heaps, data, centres, expired)
    return heaps, data, change, sum(map(len, expired)), moved


STATE = "block long, bounds array<int>, place binary, gap binary, change array<long>, scanned long, moved long"


def assigned(joined: DataFrame, centres: Centres, how: Lloyd) -> DataFrame:
    """The slim table after one more assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                heaps, _, change, n, moved = stepped(row, centres, how)
                bounds, place, gap = heaps.columns()
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "bounds": bounds, "place": place, "gap": gap, "change": change.ravel().tolist(), "scanned": n, "moved": moved}], schema)

    schema = pa.schema([("block", pa.int64()), ("bounds", pa.list_(pa.int32())), ("place", pa.binary()), ("gap", pa.binary()), ("change", pa.list_(pa.int64())), ("scanned", pa.int64()), ("moved", pa.int64())])
    return joined.mapInArrow(run, STATE)


def members(joined: DataFrame, centres: Centres, how: Lloyd) -> DataFrame:
    """The last assignment: (vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                heaps, data, *_ = stepped(row, centres, how)
                cluster = np.zeros(len(data), np.int32)
                for j, place in enumerate(heaps.place):
                    cluster[place] = j
                d = ((data.astype(np.int64) - centres.at[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster), pa.array(d)], ["vec_id", "cluster", "distance"])

    return joined.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(embeddings: DataFrame, how: Lloyd = Lloyd()) -> tuple[DataFrame, Centres, list[tuple[int, int]]]:
    """(vec_id, cluster, distance) of every vector that counts, the last centroids, and for each round how many vectors
    were scanned and how many of them moved."""
    spark = embeddings.sparkSession
    vectors = embeddings.select("vec_id", whole(F.col("embedding"), how).alias("v")).where("v is not null")
    drawn = F.sha2(F.concat(F.lit(how.seed), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(drawn.asc_nulls_last(), "v").limit(how.k).collect()
    n = max(spark.sparkContext.defaultParallelism, min(100_000, -(-vectors.count() // how.bucket)))
    packed = bucketed(blocks(vectors, how).repartition(n, "block"), "block", n)
    at = np.array([r.v for r in first], np.int64).reshape(len(first), how.components)
    centres = Centres(at, np.zeros(len(first)), [0] * len(first), [[0] * how.components for _ in first])
    joined, state, story = packed, None, []
    for _ in range(how.rounds if first else 0):
        before, state = state, bucketed(assigned(joined, centres, how), "block", n)
        if before is not None:
            forgotten(before)
        size = 1 + how.components
        flat = F.concat("change", F.array("scanned", "moved"))
        sums = dict(state.select(F.posexplode(flat).alias("i", "x")).groupBy("i").agg(F.sum("x")).collect())  # k * (components + 1) + 2 rows
        for j in range(len(first)):
            centres.count[j] += sums[j * size]
            centres.total[j] = [t + sums[j * size + 1 + i] for i, t in enumerate(centres.total[j])]
        story.append((sums[len(first) * size], sums[len(first) * size + 1]))
        joined = packed.join(state.select("block", "bounds", "place", "gap").hint("merge"), "block")
        if not centres.moved():
            break  # all further rounds would repeat this one
    return members(joined, centres, how), centres, story


def digest(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in centre.tolist()).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centres, _ = clustered(table(spark, sf_dir, "embeddings"))
    out = cut(out)
    of = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row a cluster
    inertia = of.agg(F.sum("cluster_inertia").alias("inertia"))  # one row
    names = F.array(*(F.lit(digest(c)) for c in centres.at)) if len(centres.at) else F.array(F.lit(""))
    return out.join(F.broadcast(of), "cluster").crossJoin(F.broadcast(inertia)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.get(names, F.col("cluster")).alias("centroid_sha256"))


def oracle(how: Lloyd = Lloyd()) -> str:
    """All rounds in SQL over (row, component, value)."""
    steps = [
        f"""kept as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(x::double * {how.scale})::bigint) v from embeddings
  where len(embedding) = {how.components} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {how.components})""",
        f"p as materialized (select r, unnest(range({how.components})) i, unnest(v) x from kept)",
        f"c0 as materialized (select k, unnest(range({how.components})) i, unnest(v) x from (select v, row_number() over (order by sha256('{how.seed}' || vec_id) nulls last, v) - 1 k from kept) where k < {how.k})",
    ]
    for t in range(how.rounds + 1):
        steps.append(f"a{t} as materialized (select r, arg_min(k, struct_pack(d := d, k := k)) k, min(d) d from (select r, k, sum((p.x - c.x) * (p.x - c.x))::bigint d from p join c{t} c using (i) group by r, k) group by r)")
        steps.append(f"c{t + 1} as materialized (select k, i, coalesce(m.x, c.x) x from c{t} c left join (select k, i, floor(sum(p.x) / count(*))::bigint x from p join a{t} using (r) group by k, i) m using (k, i))")
    last = how.rounds
    return f"""with {", ".join(steps[:-1])}, s as (select k, sha256(string_agg(x::varchar, ',' order by i)) h from c{last} group by k)
select vec_id, k::int "cluster", d distance, (sum(d) over (partition by k))::bigint cluster_inertia, (sum(d) over ())::bigint inertia, h centroid_sha256 from a{last} join kept using (r) join s using (k)"""


ORACLE = oracle()
