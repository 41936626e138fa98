"""What the operators of this subpackage share: reading tables, cutting lineage, defined handling of odd columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceqc.functions.lineage import cut, own_dir, released, shared_dir

__all__ = ["cut", "fresh", "let", "narrowed", "own_dir", "released", "shared_dir", "split", "table", "without", "words_of"]

#: What separates words in most contracts: space, tab, LF, VT, FF, CR.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever number of times ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are no blanks; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


#: Bits of one row of a key set; what ``bitmap_construct_agg`` makes.
CHUNK_BITS = 15
#: A key set has at least and at most 2 ** so many bits; the most is 64 MB.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 20, 29, 16


def set_bits(n: int, most: int | None = None) -> int:
    """The logarithm of the size of a set of ``n`` keys."""
    return min(max(LEAST_BITS, math.ceil(math.log2(max(1, n) * BITS_A_KEY))), MOST_BITS if most is None else most)


def split(df: DataFrame, keys: DataFrame, key: str, most_bits: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ``df`` whose ``key`` may be in ``keys``, all other rows); none that is there is lost.

    What is broadcast is a set of ``BITS_A_KEY`` bits a key, so about a sixteenth of the other rows stay with the
    first part, whatever the number of keys, until the set would take more than 64 MB (33 million keys). Beyond that
    it fills up; where it would hold more than half of the other rows, there is no second part.
    """
    n = keys.count()
    bits = set_bits(n, most_bits)
    if 1 - math.exp(-n / (1 << bits)) > 0.5:
        return df, None
    bucket = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    at, chunk, bitmap = (fresh(df, name) for name in ("_place", "_chunk", "_held"))
    place = F.col(at).bitwiseAND((1 << CHUNK_BITS) - 1)
    held = keys.select(bucket.alias(at)).groupBy(F.shiftright(at, CHUNK_BITS).alias(chunk)).agg(F.bitmap_construct_agg(place).alias(bitmap))
    # at most 2 ** (MOST_BITS - CHUNK_BITS) rows of 4 KB
    tested = df.withColumn(at, bucket).withColumn(chunk, F.shiftright(at, CHUNK_BITS)).join(F.broadcast(held), chunk, "left")
    octet = F.conv(F.hex(F.substring(bitmap, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.coalesce(F.getbit(octet, place.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return tuple(tested.where(x).select(*df.columns) for x in (inside, ~inside))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` has not."""
    while name in df.columns:
        name += "_"
    return name


def narrowed(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``keys``: none that is there is lost, few others stay."""
    return split(df, keys, key)[0]


def without(df: DataFrame, gone: DataFrame, key: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``df`` whose ``key`` (and further columns ``also``) are not in ``gone``; only rows that may be are shuffled.

    A null key is in ``gone`` if a null key is there.
    """
    named = {k: fresh(df, f"_gone_{k}") for k in (key, *also)}
    right = gone.select(*(F.col(k).alias(name) for k, name in named.items()))
    on = [F.col(k).eqNullSafe(F.col(name)) for k, name in named.items()]
    maybe, sure = split(df, gone, key)
    left = maybe.join(right, on, "left_anti")
    return left if sure is None else sure.unionByName(left)
