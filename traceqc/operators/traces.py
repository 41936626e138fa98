"""Rebuilding sampled curves from the line segments of a page.

Segments come with their draw order (``seq``). All steps are keyed by record and page, so one exchange serves them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceqc.functions import text as T

PAGE = ["rec", "page_no"]
MARKER = "标记"
MIN_SEGMENTS, MIN_DX, LABEL_X = 500, 0.1, 100.0


def labels(words: DataFrame) -> DataFrame:
    """Row labels at the left edge of a page (channels and the marker) with their centre, numbered from the top."""
    order = Window.partitionBy(*PAGE).orderBy("center", "seq")
    own = words.where((F.col("x0") < LABEL_X) & (F.col("text").rlike(T.CHANNEL) | (F.col("text") == MARKER)))
    own = own.select(*PAGE, "seq", F.col("text").alias("ch"), ((F.col("top") + F.col("bottom")) / 2).alias("center"))
    return own.withColumn("ch_idx", F.row_number().over(order) - 1).select(*PAGE, "ch_idx", "ch", "center")


def kept(segments: DataFrame) -> DataFrame:
    """Segments that advance in x."""
    return segments.where(F.abs(F.col("x1") - F.col("x0")) > MIN_DX)


def page_rows(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Pages that can be rebuilt (labels, and enough segments), with the centres of their rows in order."""
    rows = labels(words).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ch_idx", "center"))).alias("rows"))
    enough = kept(segments).groupBy(*PAGE).agg(F.count("*").alias("n_segments")).where(F.col("n_segments") >= MIN_SEGMENTS)
    return rows.join(enough, PAGE).select(*PAGE, "n_segments", F.size("rows").alias("n_rows"), F.transform("rows", lambda r: r["center"]).alias("centers"))


def assigned(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Each segment of a page that can be rebuilt, with its column ``j``, its row ``ch_idx`` and the page's samples ``n``.

    In a column with one segment for each row, draw order is row order; in any other, which is marked ambiguous, a
    segment goes to the row whose centre is nearest to its start, the upper one on ties. Segments are exchanged once, by
    page; all windows share that key.
    """
    rows = labels(words).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ch_idx", "center"))).alias("rows"))
    rows = rows.select(*PAGE, F.size("rows").alias("n_rows"), F.transform("rows", lambda r: r["center"]).alias("centers"))
    page = Window.partitionBy(*PAGE)
    s = kept(segments).select(*PAGE, "seq", F.round("x0", 2).alias("xkey"), "y0", "y1").join(rows, PAGE)
    s = s.withColumn("_of_page", F.count("*").over(page)).where(F.col("_of_page") >= MIN_SEGMENTS)
    column = Window.partitionBy(*PAGE, "xkey")
    nearest = F.array_min(F.transform("centers", lambda c, i: F.struct(F.abs(c - F.col("y0")).alias("d"), i.alias("i"))))["i"]
    s = s.withColumn("j", F.dense_rank().over(page.orderBy("xkey")) - 1)
    s = s.withColumn("k", F.row_number().over(column.orderBy("seq")) - 1).withColumn("ambiguous", F.count("*").over(column) != F.col("n_rows"))
    s = s.withColumn("n", F.max("j").over(page) + 2)
    return s.select(*PAGE, "seq", "xkey", "j", F.when(F.col("ambiguous"), nearest).otherwise(F.col("k")).alias("ch_idx"), "ambiguous", "y0", "y1", "n_rows", "n")


def points(assigned_segments: DataFrame) -> DataFrame:
    """One y for each row and sample: the start of the last segment of its column, else the end of the last one of the
    column before. Both ends of a segment come from one pass."""
    end = lambda j, prio, y: F.struct(j.alias("j"), F.struct(F.lit(prio).alias("prio"), "seq").alias("rank"), F.col(y).alias("y"))
    ends = assigned_segments.select(*PAGE, "ch_idx", "n", F.inline(F.array(end(F.col("j"), 1, "y0"), end(F.col("j") + 1, 0, "y1"))))
    return ends.groupBy(*PAGE, "ch_idx", "j").agg(F.max_by("y", "rank").alias("y"), F.first("n").alias("n"))


def gap_filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``samples``: known points on the whole grid, gaps filled linearly, flat beyond the ends, where over two are known."""
    for batch in batches:
        out = []
        for known, n in zip(batch.column("known"), batch.column("n").to_pylist()):
            at = known.values.field("j").to_numpy() if known.is_valid else np.zeros(0, np.int64)
            y = np.full(n, np.nan)
            if len(at):
                value = known.values.field("y").to_numpy(zero_copy_only=False)
                order = np.argsort(at)
                if len(at) > 2:
                    y = np.interp(np.arange(n), at[order], value[order])
                else:
                    y[at] = value
            out.append(pa.array(y, from_pandas=True))
        columns = [batch.column(c) for c in batch.schema.names if c not in ("known", "n")]
        names = [c for c in batch.schema.names if c not in ("known", "n")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.float64()))], [*names, "samples"])


def signals(segments: DataFrame, words: DataFrame) -> DataFrame:
    """One row for each page and row: its label, its centre and its samples (in points, downwards)."""
    known = points(assigned(segments, words)).groupBy(*PAGE, "ch_idx").agg(F.collect_list(F.struct("j", "y")).alias("known"), F.max("n").alias("n"))
    rows = labels(words).join(known, [*PAGE, "ch_idx"], "left")
    # rows without a segment are as long as the others of their page; pages without any are no pages
    rows = rows.withColumn("n", F.max("n").over(Window.partitionBy(*PAGE))).where("n is not null")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ", ".join(f"{c} {kinds[c]}" for c in (*PAGE, "ch_idx", "ch", "center"))
    return rows.select(*PAGE, "ch_idx", "ch", "center", "known", "n").mapInArrow(gap_filled, f"{out}, samples array<double>").select(*PAGE, "ch_idx", "samples", "ch", "center")


def geometry(segments: DataFrame) -> DataFrame:
    """Smallest step between y coordinates, and median step between columns, of each page."""
    s = kept(segments)
    ys = s.select(*PAGE, F.explode(F.array(F.round("y0", 3), F.round("y1", 3))).alias("v")).distinct()
    step = lambda df: df.withColumn("step", F.col("v") - F.lag("v").over(Window.partitionBy(*PAGE).orderBy("v")))
    smallest = step(ys).groupBy(*PAGE).agg(F.min(F.when(F.col("step") > 0.0005, F.col("step"))).alias("min_ystep"))
    xs = s.select(*PAGE, F.round("x0", 2).alias("v")).distinct()
    return smallest.join(step(xs).groupBy(*PAGE).agg(F.median("step").alias("med_xstep")), PAGE)


def decimals(segments: DataFrame, first: int = 2000) -> DataFrame:
    """How many decimals the y coordinates of the first segments of a page have: (page, decimals, n)."""
    order = Window.partitionBy(*PAGE).orderBy("seq")
    s = kept(segments).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first)
    shown = F.rtrim(F.format_string("%.6f", "y"), F.lit("0"))
    ys = s.select(*PAGE, F.explode(F.array("y0", "y1")).alias("y"))
    return ys.groupBy(*PAGE, (F.length(shown) - F.instr(shown, ".")).alias("decimals")).agg(F.count("*").alias("n"))


def decimal_maps(counts: DataFrame) -> DataFrame:
    """The counts of ``decimals`` as one map a page."""
    return counts.groupBy(*PAGE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("decimals", "n")))).alias("dec_hist"))


def paired(rebuilt: DataFrame, waves: DataFrame) -> DataFrame:
    """The k-th page of a record that can be rebuilt with the k-th entry of its waveform list; extra ones are dropped."""
    place = lambda order: F.row_number().over(Window.partitionBy("rec").orderBy(order))
    left = rebuilt.select(*PAGE).withColumn("k", place("page_no"))
    right = waves.withColumn("k", place("wave_idx")).drop(*(c for c in PAGE if c != "rec"))
    return left.join(right, ["rec", "k"])


def mismatched(rebuilt: DataFrame, waves: DataFrame) -> DataFrame:
    """Records whose numbers of rebuilt pages and waveform entries differ."""
    a = rebuilt.groupBy("rec").agg(F.count("*").alias("n_pages"))
    b = waves.groupBy("rec").agg(F.count("*").alias("n_waves"))
    both = a.join(b, "rec", "full").select("rec", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pages", "n_waves")))
    return both.where("n_pages <> n_waves")
