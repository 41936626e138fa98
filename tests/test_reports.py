from pyspark.sql import functions as F

from traceqc.functions import text as T
from traceqc.operators import reports as R
from traceqc.sources import io


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_clean(spark):
    cases = {"  a b  c 中 d": "a bc中d", "　中 文　": "中文", "ab 12\tx": "ab 12\tx", "a  b": "ab", None: None, "": ""}
    for value, expected in cases.items():
        assert one(spark, value, T.clean) == expected


def test_an_empty_field_does_not_take_the_next_line(spark):
    header = "药物：\n临床诊断： x y\n"
    assert one(spark, header, lambda c: T.field(c, R.HEADER["medication"])) == ""
    assert one(spark, header, lambda c: T.field(c, R.HEADER["diagnosis"])) == "x y"


def test_wrapped_lines(spark):
    text = "基本 节律，\n 两侧\n\n对称。\n诱发：无；\n变化 \n x：1"
    assert one(spark, text, T.join_wrapped) == "基本节律，两侧对称。\n诱发：无；\n变化\nx：1"


def test_sections_without_topography(spark):
    cols = lambda c: F.array(*T.sections(c))
    assert one(spark, "abc结论：d", cols) == ["abc", "", "d"]
    assert one(spark, "abc脑电地形图：t结论：d", cols) == ["abc", "t", "d"]
    assert one(spark, "abc结论：d脑电地形图：", cols) == ["abc", "", "d"]


def test_pages_and_record_ids(spark):
    docs = [("a", "no id\fx 编号： 12\f"), ("b", ""), ("c", "编号：7\n姓名：n 脑电图：\n\f姓名 脑电图\fO1-A1\n标记\n8秒 10:00:00 背景 50uV/5mm 3厘米/秒 编号：9\f\f")]
    pages = io.pages(spark.createDataFrame(docs, "source_file string, text string"))
    assert {r.source_file: r.n_pages for r in pages.collect()} == {"a": 2, "b": 1, "c": 4}
    assert {r.source_file: r.record_id for r in R.reports(pages).collect()} == {"a": "12", "b": "", "c": "7"}
    waves = R.waveform_pages(pages).where("source_file = 'c'").collect()
    assert [(w.page_no, w.wave_idx, w.channels, w.marker_row, w.stage) for w in waves] == [(3, 2, ["O1-A1"], True, "背景")]
    assert {r.source_file: len(r.waveforms) for r in R.nested(pages).collect()} == {"a": 0, "b": 0, "c": 1}


def test_a_record_id_may_begin_the_next_page(spark):
    docs = [("a", "x\fend 编号：\f \n\f 31 y\f编号：5"), ("b", "编号：\fno 7"), ("c", "x 编号： 4 编号：\f9"), ("d", "编号：\f编号：8"), ("e", "编号：")]
    pages = io.pages(spark.createDataFrame(docs, "source_file string, text string"))
    assert {r.source_file: r.any_id for r in R.any_record_id(pages).collect()} == {"a": "31", "c": "4", "d": "8"}


def test_subject_and_manual_tables(spark, tmp_path):
    io.write_csv(spark.createDataFrame([("S1", " A", "05", "M"), ("S2", None, "", "F")], "subject_id string, name string, age string, sex string").coalesce(1), f"{tmp_path}/s")
    assert sorted(tuple(r) for r in io.read_subjects(spark, f"{tmp_path}/s").collect()) == [("S1", " A", "05", "M"), ("S2", None, None, "F")]
    spark.createDataFrame([(1, 2)], "record_id long, subject_id int").write.parquet(f"{tmp_path}/m.parquet")
    assert io.read_manual(spark, f"{tmp_path}/m.parquet").first() == ("1", "2")
    assert io.read_manual(spark, None) is None and io.read_manual(spark, f"{tmp_path}/none.csv") is None


def test_seconds_and_sensitivity(spark):
    assert [one(spark, v, T.seconds) for v in ("起点12秒 3", "x", "", None, "9" * 20)] == [12, None, None, None, None]
    assert one(spark, "50uV/3.5mm", lambda c: F.array(*T.sensitivity(c))) == [50.0, 3.5]
    assert one(spark, "x50uV/3.5mm", lambda c: F.array(*T.sensitivity(c))) == [None, None]


def test_csv_keeps_line_ends_and_quotes(spark, tmp_path):
    rows = [("a", 'x\ny "q", z'), ("b", ""), ("c", None)]
    io.write_csv(spark.createDataFrame(rows, "k string, v string").coalesce(1), f"{tmp_path}/c")
    assert sorted(tuple(r) for r in io.read_csv(spark, f"{tmp_path}/c", ["k", "v"]).collect()) == [("a", 'x\ny "q", z'), ("b", None), ("c", None)]
    part = next(tmp_path.glob("c/part-*")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfk,v\n")
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfk,v\n1,2\n")
    assert io.read_csv(spark, f"{tmp_path}/bom.csv", ["k", "v"]).first().k == "1"


def test_the_last_file_of_a_record_stays(spark):
    df = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "c", 3)], "record_id string, source_file string, v int")
    assert sorted(r.v for r in io.latest(df).collect()) == [2, 3]


def test_extraction_qa(spark):
    df = spark.createDataFrame([("1", ""), ("1", None), ("2", "x"), (None, "y"), (None, "y")], "record_id string, name string")
    got = {(r.measure, r.column): r.n for r in R.extraction_qa(df).collect()}
    assert got == {("rows", ""): 5, ("columns", ""): 2, ("repeated", "record_id"): 2, ("null", "record_id"): 2, ("null", "name"): 1, ("empty", "name"): 1}
