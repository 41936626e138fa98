"""WARC archives: writing pages as records, and reading archives back by boundary-chain verification.

Writing: a page is one record; of pages with equal payloads of at least ``min_revisit_bytes`` bytes, that with the
smallest id is stored whole and the others are revisit records that refer to it. Spark's text writer, whose line
separator is the blank line that ends a record, writes the archives to the shared folder.

Reading: Spark's text reader cuts the archives at the magic of a record start, in splits of any size. Every piece is a
candidate record; where its header ends and how long its content is gives the offset of its successor. Pieces get
their offsets by prefix sums (within a split, then over the splits of a file). Pointer jumping from offset 0 of each
file doubles the verified part of each chain in every round, so only records reachable from the start of their file
are kept; the magic inside a payload starts no record, and such pieces are put back into the record that holds them.
What the caller derives of a record's content is computed where the record is read, so contents are shuffled only for
records that the magic cuts.

Defined results: a null or empty payload gives a response record without payload; a record whose header can't be read
ends its file's chain, and nothing after it is trusted (the writer escapes the magic in URLs, so that headers never hold
it); archives without records give an empty result; a page without an id is a
response and comes back without one; repeated page
ids are written as they are, and a revisit refers to the smallest id; payloads of any length are stored and read whole;
further columns, of whatever names, are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceqc.llm.common import cut, narrowed, own_dir, split, table

MAGIC = "WARC/1."
END = "\r\n\r\n"
ID = "urn:page:"
MIN_REVISIT_BYTES = 100


def plan_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Each page's payload, digest and, where an equal payload is stored elsewhere, the id it refers to.

    The smallest id of a payload is found by a pre-aggregated grouping of digests; only ids and digests take part.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= min_revisit_bytes
    first = cut(rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # payloads that can't be repeated need no join, so they aren't shuffled
    maybe, alone = split(rows, first, "digest")
    some = maybe.join(first, "digest", "left").withColumn("refers_to", F.when(long & (F.col("first") != F.col("page_id")), F.col("first")).cast("long")).drop("first")
    return some if alone is None else alone.withColumn("refers_to", F.lit(None).cast("long")).unionByName(some)


def record(row_id: Column) -> Column:
    """The bytes of a record, as text, without the blank line that ends it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.octet_length("payload").cast("string")), F.lit("\r\n"))
    body = F.when(F.col("refers_to").isNull(), F.col("payload").cast("string")).otherwise(F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20"), r"WARC/1\.", "WARC%2F1.")
    block = F.concat(http, body)
    head = F.concat(
        F.lit(f"{MAGIC}1\r\n"),
        line("WARC-Type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), F.coalesce(row_id.cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("refers_to").isNull(), "").otherwise(F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.col("refers_to").cast("string"), F.lit(">"))))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, block)


def write(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", payload_col: str = "html") -> None:
    """Writes one record a page to archives below ``path``."""
    planned = plan_records(pages, min_revisit_bytes, id_col, payload_col)
    planned.select(record(F.col("page_id")).alias("value")).write.option("lineSep", END).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every magic: file, split, order and bytes up to the next magic.

    The first piece of a file stands before its first magic. Splits depend on the number of cores unless that of
    partitions is set, so both readings of an archive set it.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("body"))


class FixedSplits:
    """Within it, files are cut into the same splits whatever executors there are."""

    KEY = "spark.sql.files.minPartitionNum"

    def __init__(self, spark: SparkSession):
        self.spark, self.before = spark, spark.conf.get(self.KEY, None)

    def __enter__(self):
        self.spark.conf.set(self.KEY, self.before or "8")

    def __exit__(self, *_):
        self.spark.conf.unset(self.KEY) if self.before is None else self.spark.conf.set(self.KEY, self.before)


def with_offsets(slim: DataFrame) -> DataFrame:
    """Adds ``off``: where the magic before a piece stands in its file; -7 for the first piece of a file."""
    within = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = slim.groupBy("file", "split").agg(F.sum("size").alias("total"))
    starts = starts.select("file", "split", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("start"))
    local = slim.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return local.join(starts, ["file", "split"]).withColumn("off", F.col("start") + F.col("local") - len(MAGIC)).drop("start", "local")


def header_of(body: Column) -> Column:
    """The header of a piece with the CRLF of its last line; null if it doesn't end within the piece."""
    text = body.cast("string")
    return F.when(F.instr(text, END) > 0, F.concat(F.substring_index(text, END, 1), F.lit("\r\n")))


def named(header: Column, name: str) -> Column:
    """The value of a header line, null without one; names in any case."""
    return F.nullif(F.regexp_extract(header, rf"(?i)\r\n{name}[ \t]*:[ \t]*([^\r\n]*)\r\n", 1), F.lit(""))


def reachable(candidates: DataFrame) -> DataFrame:
    """Of candidates (file, off, next), those on the chain of successors from offset 0 of their file.

    Each round doubles the length of the jumps: what a verified record reaches by a jump is verified, and each jump is
    followed by that of its target. Chains of n records need log2(n) rounds, and end because offsets only grow.
    """
    state = cut(candidates.select("file", "off", F.col("next").alias("jump"), (F.col("off") == 0).alias("good")))
    while state.where("good and jump is not null").limit(1).count():
        live = state.where("jump is not null")
        target = state.select("file", F.col("off").alias("jump"), F.col("jump").alias("then"))
        hit = live.where("good").select("file", F.col("jump").alias("off")).distinct().withColumn("hit", F.lit(True))
        # rows whose chain ended need no join, where all their nulls would meet in one task
        moved = live.join(target, ["file", "jump"], "left").select("file", "off", F.col("then").alias("jump"), "good").unionByName(state.where("jump is null"))
        state = cut(moved.join(hit, ["file", "off"], "left").select("file", "off", "jump", (F.col("good") | F.coalesce("hit", F.lit(False))).alias("good")))
    return state.where("good").select("file", "off")


def block_of(body: Column, header: Column, content: Column) -> Column:
    """The content block of a piece or an assembled record."""
    return F.substring(body, (F.octet_length(header) + 3).cast("int"), content.cast("int"))


def read(spark: SparkSession, path: str, derive=lambda block: block) -> DataFrame:
    """The verified records below ``path``: file, offset, header and what ``derive`` makes of the content block."""
    with FixedSplits(spark):
        raw = pieces(spark, path).withColumn("header", header_of(F.col("body"))).withColumn("content", named(F.col("header"), "Content-Length").try_cast("long"))
        raw = raw.withColumn("size", F.octet_length("body").cast("long") + len(MAGIC)).withColumn("skip", (F.octet_length("header") + 2 + len(MAGIC)).cast("long"))
        whole = F.col("skip") + F.col("content") <= F.col("size")
        derived = F.when(whole, derive(block_of(F.col("body"), F.col("header"), F.col("content")))).alias("derived")
        slim = cut(raw.select("file", "split", "seq", "size", "header", "content", "skip", whole.alias("whole"), derived))
        at = cut(with_offsets(slim.select("file", "split", "seq", "size", "content", "skip", "whole"))).where("off >= 0")
        candidates = at.where("content >= 0").withColumn("next", F.col("off") + F.col("skip") + F.col("content") + len(END))
        good = cut(reachable(candidates).join(at, ["file", "off"]).where("content >= 0").select("file", "off", "split", "seq", "whole"))
        out = slim.join(good.where("whole").select("file", "split", "seq", "off"), ["file", "split", "seq"]).select("file", "off", "header", "derived")
        if good.where("not whole").limit(1).count() == 0:
            return out
        # the pieces of a record that the magic cuts: those after it and before the next verified one
        marked = at.join(good.select("file", "off", F.col("off").alias("owner")), ["file", "off"], "left")
        within = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        over = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        tails = marked.groupBy("file", "split").agg(F.max("owner").alias("tail"))
        tails = tails.select("file", "split", F.max("tail").over(over).alias("earlier"))
        owned = marked.withColumn("owner", F.max("owner").over(within)).join(tails, ["file", "split"]).withColumn("owner", F.coalesce("owner", "earlier"))
        broken = good.where("not whole").select("file", F.col("off").alias("owner"))
        needed = cut(owned.join(broken, ["file", "owner"]).select("file", "split", "seq", "off", "owner"))
        parts = narrowed(pieces(spark, path), needed, "seq").join(needed, ["file", "split", "seq"])
        parts = parts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("off", "body"))).alias("parts"))
        first = F.get("parts", F.lit(0))["body"]
        more = F.aggregate(F.slice("parts", 2, F.size("parts")), first, lambda a, x: F.concat(a, F.lit(MAGIC.encode()), x["body"]))
        joined = cut(parts.select("file", F.col("owner").alias("off"), more.alias("body")))
    joined = joined.withColumn("header", header_of(F.col("body"))).withColumn("content", named(F.col("header"), "Content-Length").try_cast("long"))
    block = block_of(F.col("body"), F.col("header"), F.col("content"))
    return out.unionByName(joined.where(F.octet_length(block) == F.col("content")).select("file", "off", "header", derive(block).alias("derived")))


def http_of(block: Column) -> Column:
    """Of an HTTP response: its header, and the size and digest of its payload."""
    header = header_of(block)
    payload = F.substring(block, (F.octet_length(header) + 3).cast("int"), F.octet_length(block))
    return F.struct(header.alias("http"), F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("digest"))


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the verified records: id, size and digest of the full payload, type, and what a revisit refers to.

    A revisit stores no payload: its digest is that of its header, its size that of the HTTP header it repeats.
    """
    page = lambda name: F.regexp_extract(named(F.col("header"), name), rf"{ID}(-?\d+)", 1).try_cast("long")
    out = read(spark, path, http_of).withColumn("kind", F.lower(named(F.col("header"), "WARC-Type"))).where("kind in ('response', 'revisit')")
    claimed = F.regexp_extract(named(F.col("header"), "WARC-Payload-Digest"), "(?i)^sha256:(.*)$", 1)
    stored = F.col("kind") == "response"
    return out.select(
        page("WARC-Record-ID").alias("page_id"),
        F.when(stored, F.col("derived.size")).otherwise(named(F.col("derived.http"), "Content-Length").try_cast("long")).alias("payload_bytes"),
        F.when(stored, F.col("derived.digest")).otherwise(claimed).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{own_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    return responses(spark, path)


ORACLE = """
select page_id, octet_length(encode(coalesce(html, '')))::bigint payload_bytes, sha256(coalesce(html, '')) payload_digest,
  case when first_ is null or first_ = page_id then 'response' else 'revisit' end record_type,
  case when first_ <> page_id then first_ end refers_to
from (
  select *, case when octet_length(encode(html)) >= 100 then min(page_id) over (partition by html) end first_ from pages)
"""
