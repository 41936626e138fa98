import hashlib
import random

from traceqc.llm import warc

SCHEMA = "page_id long, url string, html string, kind string"


def expected(rows):
    out = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        same = [j for j, _, h, _ in rows if (h or "").encode() == body]
        first = min(same) if len(body) >= 100 else i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


def round_trip(spark, rows, path, parts=3):
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(parts), path)
    return sorted((tuple(r) for r in warc.responses(spark, path).collect()), key=str)


def test_payloads_that_look_like_records_and_odd_rows(spark, tmp_path):
    """Nulls, empty payloads, copies, URLs and payloads with the magic, and whole records inside a payload."""
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [
        (1, "http://a/WARC/1.1\r\nX: 1", "x" * 150, "k"),
        (2, None, None, None),
        (3, "http://b", "", "k"),
        (4, "http://c", "x" * 150, "k"),
        (5, "http://d", fake * 3 + "é" * 70, "k"),
        (6, "http://e", "\r\n\r\n" + fake, "k"),
        (7, "http://f", "x" * 99, "k"),
        (8, "http://g", "x" * 99, "k"),
        (9, "http://h", fake * 3 + "é" * 70, "k"),
        (10, "http://i", "WARC/1.WARC/1.\r\n\r\n", "k"),
        (-3, "http://j", "\n\r\n\r" * 40, "k"),
    ]
    assert round_trip(spark, rows, f"{tmp_path}/w") == expected(rows)


def test_small_splits(spark, tmp_path):
    """Records that lie across many splits of a file."""
    rng = random.Random(5)
    text = lambda: "".join(rng.choice(["WARC/1.0\r\n", "\r\n\r\n", "abc", "ü", " "]) for _ in range(rng.randint(0, 200)))
    rows = [(k, f"http://x/{k}", text(), "k") for k in range(60)]
    rows += [(100 + k, "http://y", rows[k][2], "k") for k in range(20)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        assert round_trip(spark, rows, f"{tmp_path}/w", 1) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/w")
    assert warc.responses(spark, f"{tmp_path}/w").count() == 0


def test_a_broken_chain_ends_its_file(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 5\r\n\r\nok\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(good % 1 + good % 2 + bad + good % 3)
    (tmp_path / "b.warc").write_bytes(good % 4)
    got = warc.read(spark, str(tmp_path)).select("header").collect()
    ids = sorted(int(r.header.split("urn:page:")[1].split(">")[0]) for r in got)
    assert [i for i in ids if i != 7] == [1, 2, 4] and 3 not in ids
