import pytest
from pyspark.sql import functions as F

from traceqc.operators import dates as D
from traceqc.operators import linkage as L

REPORT = "source_file string, record_id string, name string, age string, sex string"
SUBJECT = "subject_id string, name string, age string, sex string"


def link(spark, reports, subjects, manual=None):
    m = None if manual is None else spark.createDataFrame(manual, "record_id string, subject_id string")
    out = L.linked(spark.createDataFrame(reports, REPORT), spark.createDataFrame(subjects, SUBJECT), m)
    return {r.source_file: (r.subject_id, r.match_method) for r in out.collect()}


def test_tiers(spark):
    subjects = [("S1", " A ", "30", "M"), ("S2", "B", "40", "F"), ("S3", "B", "40", "F"), ("S4", "C", "50", "M"), ("S5", "C", "53", "M"), ("S6", "D", "x", "F"), ("S7", None, None, "M"), ("S8", "E", "05", "F")]
    reports = [("1", "r1", "A", "30", "M"), ("2", "r2", "B", "40", "F"), ("3", "r3", "C", "48", "M"), ("4", "r4", "C", "52", "M"), ("5", "r5", "D", "20", "F"), ("6", "r6", None, None, "M"), ("7", "r7", "E", "5", "F"), ("8", "r8", "A", "33", "M"), ("9", "r1", "Z", "bad", "M")]
    got = link(spark, reports, subjects)
    tier2 = L.tier2_label(2)
    assert got == {
        "1": ("S1", L.TIER1), "2": (None, ""), "3": ("S4", tier2), "4": (None, ""), "5": (None, ""), "6": ("S7", L.TIER1), "7": ("S8", tier2), "8": (None, ""), "9": (None, ""),
    }
    manual = link(spark, reports, subjects, [("r1", None), ("r2", "M2")])
    assert manual["1"] == (None, L.MANUAL) and manual["9"] == (None, L.MANUAL) and manual["2"] == ("M2", L.MANUAL) and manual["3"] == got["3"]


def test_a_record_that_stands_twice_in_the_manual_table_is_an_error(spark):
    with pytest.raises(Exception, match="more than one row for r1"):
        link(spark, [("1", "r1", "A", "30", "M")], [("S1", "A", "30", "M")], [("r1", "a"), ("r1", "b")])


def test_gaps(spark):
    subjects = spark.createDataFrame([("1", "2024-01-02 06:00:00", "2024-01-03"), ("2", "2024-01-10 00:00:00", "bad"), ("3", "2024-01-10 00:00:00", None), ("4", "2024-01-10 00:00:00", "2024-1-5")], "subject_id string, t string, eeg_time string")
    subjects = subjects.withColumn("test_time", F.to_timestamp("t"))
    reports = spark.createDataFrame([("2", "f2", "r", "2024-01-01"), ("2", "f1", "r", "2024-01-09"), ("4", "f", "r", "2024/1/5"), (None, "f", "r", "2024-01-01")], "subject_id string, source_file string, record_id string, exam_date string")
    got = {r.subject_id: (r.gap_days, r.eeg_date_source, r.eeg_date_changed) for r in D.reconciled(subjects, reports).collect()}
    assert got == {"1": (-1, D.ORIGINAL, 0), "2": (1, D.FROM_REPORT, 1), "3": (None, D.MISSING, 0), "4": (5, D.FROM_REPORT, 0)}


def test_strict_dates_and_checked_merge(spark):
    with pytest.raises(Exception, match="no date"):
        spark.createDataFrame([("x",)], "a string").select(D.strict(F.col("a"))).collect()
    table = spark.createDataFrame([("1", 0), (None, 0), ("9", 0)], "subject_id string, gap_days int")
    gaps = "subject_id string, eeg_date date, eeg_date_source string, eeg_date_changed int, gap_days int"
    out = D.merged(table, spark.createDataFrame([("1", None, "s", 1, 5), (None, None, "s", 1, 6)], gaps))
    assert {r.subject_id: r.gap_days for r in out.collect()} == {"1": 5, None: 6, "9": None}
    with pytest.raises(Exception, match="more than one row"):
        D.merged(table, spark.createDataFrame([("1", None, "s", 1, 5), ("1", None, "s", 1, 6)], gaps)).collect()
