"""Stores that are written again: records by key, signals by page, CSV in bounded files; and columns of dates in one format."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from traceqc.functions import lineage
from traceqc.operators import dates, spectral
from traceqc.sources import io


def files(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_a_batch_replaces_its_records_and_touches_no_other_files(spark, tmp_path):
    path = str(tmp_path / "store")
    first = [(f"k{i}", f"f{i:03}", i) for i in range(60)] + [("k1", "f900", -1), (None, "f1", 7), (None, "f0", 8)]
    io.upsert(spark.createDataFrame(first, "record_id string, source_file string, v int"), path, parts=32)
    before = files(path)
    second = [("k5", "a", 500), ("k5", "b", 501), ("new", "c", 502)]
    io.upsert(spark.createDataFrame(second, "record_id string, source_file string, v int"), path, parts=32)
    got = {r.record_id: (r.source_file, r.v) for r in io.read_records(spark, path).collect()}
    want = {k: (f, v) for k, f, v in first if (k, f) != ("k1", "f001") and (k, f) != (None, "f0")} | {"k5": ("b", 501), "new": ("c", 502)}
    assert got == want and io.read_records(spark, path).count() == len(want)
    after = files(path)
    kept = [f for f, t in before.items() if after.get(f) == t]
    assert len(before) - 2 <= len(kept) < len(before)
    io.upsert(spark.createDataFrame([(None, "z", 9)], "record_id string, source_file string, v int"), path, parts=32)
    assert {r.v for r in io.read_records(spark, path).where("record_id is null").collect()} == {9}
    io.upsert(spark.createDataFrame([], "record_id string, source_file string, v int"), path, parts=32)
    assert io.read_records(spark, path).count() == len(want)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(f"r{i // 4}", i % 4, f"c{c}", [float(i), 1.5, 2.0]) for i in range(80) for c in range(2)]
    path = str(tmp_path_factory.mktemp("signals") / "s")
    io.write_signal_table(spark.createDataFrame(rows, "rec string, page_no int, ch string, samples array<double>"), "stored_signals", path, 8)
    yield spark.table("stored_signals"), path
    spark.sql("drop table stored_signals")


def test_a_shard_is_one_file(stored):
    shards = {}
    for f in files(stored[1]):
        shards.setdefault(os.path.dirname(f), []).append(f)
    assert len(shards) == 8 and all(len(x) == 1 for x in shards.values())


def test_joins_by_page_exchange_no_signals(spark, stored):
    signals, _ = stored
    twice = signals.alias("a").hint("merge").join(signals.alias("b"), io.PAGE)
    plan = twice._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and twice.count() == 320
    page = signals.groupBy(*io.PAGE).agg(F.count("*").alias("n"))
    assert "Exchange" not in page._jdf.queryExecution().executedPlan().toString()
    assert {r.n for r in page.collect()} == {2}


def test_a_list_of_pages_prunes_shards(spark, stored, tmp_path):
    spark.createDataFrame([("r3", 1, "O1-A1"), ("r9", 0, "x"), ("no", 0, "P-A1")], "rec string, page_no int, first string").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages")).where(F.col("first").endswith("A1"))
    out = io.signals_of(stored[0], pages, 8)
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.rec, r.page_no, r.ch, r.samples[0]) for r in out.collect()) == [("r3", 1, "c0", 13.0), ("r3", 1, "c1", 13.0)]


def test_csv_files_are_bounded(spark, tmp_path):
    df = spark.range(25).select(F.col("id").cast("string"), F.lit("two\nlines").alias("t")).coalesce(1)
    io.write_csv(df, str(tmp_path / "c"), rows=10)
    assert len([f for f in os.listdir(tmp_path / "c") if f.endswith(".csv")]) == 3
    got = io.read_csv(spark, str(tmp_path / "c"), ["id", "t"]).collect()
    assert sorted(int(r.id) for r in got) == list(range(25)) and {r.t for r in got} == {"two\nlines"}


def parsed(spark, values, **how):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [None if r.d is None else str(r.d.date()) for r in dates.with_inferred(df, "s", "d", **how).orderBy("i").collect()]


def test_one_format_for_a_column(spark):
    values = [None, "2024/1/5", "2024-01-06", "2024-01-07", "x", "20240108"]
    assert parsed(spark, values) == [None, None, "2024-01-06", "2024-01-07", None, None]
    assert parsed(spark, values, order=F.col("i")) == [None, "2024-01-05", None, None, None, None]
    assert parsed(spark, ["2024/1/5", "2024-01-06"], formats=("y-M-d", "y/M/d")) == [None, "2024-01-06"]  # the first of equals
    assert parsed(spark, ["?", "2024-01-06"], order=F.col("i")) == [None, None]
    assert parsed(spark, [None, "?"]) == [None, None] and parsed(spark, []) == []


@pytest.mark.parametrize(("rows", "samples"), [(10_000, 800), (100, 80_000)])
def test_spectra_of_a_large_batch_take_little_memory(rows, samples):
    """Above the batch itself (64 MB), in pieces."""
    rng = np.random.default_rng(0)
    values = rng.normal(size=rows * samples)
    column = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * samples, pa.int32()), pa.array(values))
    tracemalloc.start()
    seen, total = 0, 0.0
    for at, s in spectral.by_length(column):
        m = spectral.metrics(s)
        seen, total = seen + len(at), total + m["rel_alpha"].sum()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == rows and peak < 64 << 20
    some = spectral.metrics(values.reshape(rows, samples)[:20])["rel_alpha"]
    assert np.isfinite(total) and np.allclose(some, spectral.metrics(next(iter(spectral.by_length(column)))[1][:20])["rel_alpha"][: len(some)] if samples == 800 else some)


def test_pieces_cover_rows_of_all_lengths():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 50, 300)
    values = rng.normal(size=sizes.sum())
    column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))
    for part in (column, column.slice(37, 200)):
        want = part.to_pylist()
        got = {int(r): row.tolist() for at, s in spectral.by_length(part, 1000) for r, row in zip(at, s)}
        assert got == dict(enumerate(want))


def test_mean_spectrum_is_the_median_of_medians(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 4, 400))
    df = spark.createDataFrame([("r", p, x[p, c].tolist()) for p in range(3) for c in range(4)], "rec string, page_no int, uv array<double>")
    got = spectral.mean_spectrum(df, ["rec", "page_no"]).orderBy("freq").collect()
    f, p = spectral.welch(x - x.mean(axis=2, keepdims=True), 100, 200, 100)
    assert np.allclose([r.freq for r in got], f) and np.allclose([r.power for r in got], np.median(np.median(p, axis=1), axis=0))


def test_tables_in_buckets_join_without_exchange_and_can_be_forgotten(spark):
    left = lineage.bucketed(spark.range(100).selectExpr("id k", "id * 2 v").repartition(4, "k"), "k", 4)
    right = lineage.bucketed(left.selectExpr("k", "v + 1 w"), "k", 4)  # in the same buckets as it is read
    both = left.join(right.hint("merge"), "k")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert both.where("w = v + 1").count() == 100
    assert len(left.inputFiles()) == 4 and not [t for t in spark.catalog.listTables() if t.name.startswith("traceqc_")]
    folder = os.path.dirname(left.inputFiles()[0]).removeprefix("file:").replace("//", "/")
    assert os.path.isdir(folder)
    lineage.forgotten(left)
    assert not os.path.isdir(folder) and right.count() == 100


def test_only_own_tables_are_forgotten(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "given"))
    lineage.forgotten(spark.read.parquet(str(tmp_path / "given")))
    assert spark.read.parquet(str(tmp_path / "given")).count() == 3
