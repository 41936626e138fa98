import random

import brute
import duckdb

from traceqc.llm import decontamination, line_dedup

SCHEMA = "doc_id long, text string, gone string, _key int, _hit int, n_lines int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "g", 7, 8, 9) for i, t in rows], SCHEMA)


def removed(rows, k, places):
    text = rows[k][1]
    if places is None:
        return ""
    return "\n".join(x for p, x in enumerate(text.split("\n")) if p not in places)


def expected(rows):
    gone = brute.line_dedup(rows)
    return sorted(((i, removed(rows, k, gone[k]) if k in gone else t) for k, (i, t) in enumerate(rows)), key=str)


def test_equals_brute_force_and_keeps_columns(spark):
    rng = random.Random(8)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 3, 12, 30, 60])))
    pool = [line() for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "x")]
    for i in range(4, 90):
        if rng.random() < 0.4 and i > 10:
            own = (rows[rng.randrange(4, i)][1] or "").split("\n")
            a = rng.randrange(len(own))
            ls = [rng.choice(pool), *own[a : a + rng.randint(1, 8)], line()]
        else:
            ls = [rng.choice(pool) if rng.random() < 0.3 else line() for _ in range(rng.randint(1, 12))]
        rows.append((i, "\n".join(ls)))
    rows += [(200, rows[20][1]), (201, rows[20][1]), rows[30], (None, rows[20][1]), (202, "é" * 40 + "\n" + "日本 " * 20)]
    got = line_dedup.deduplicated(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "gone", "_key", "_hit", "n_lines", "n_removed"]
    out = got.collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == expected(rows)
    assert {(r.gone, r._key, r._hit) for r in out} == {("g", 7, 8)}


def test_given_documents_equal_brute_force(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = line_dedup.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == expected(rows)


def test_empty_tables(spark):
    assert line_dedup.deduplicated(frame(spark, [])).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontamination.contaminated(frame(spark, []), items).count() == 0
    assert decontamination.contaminated(frame(spark, [(1, "a b c d e f g")]), items.where("false")).count() == 0


def test_a_lone_common_line_stays(spark):
    rows = [(i, f"the header that all documents have\nunique line of the document {i:>30}") for i in range(40)]
    got = line_dedup.deduplicated(frame(spark, rows)).collect()
    assert all(r.n_removed == 0 for r in got)


def test_pairs_equal_brute_force(spark):
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    items = duckdb.sql("select item_id, text from '/root/testdata/sf0.01/benchmark.parquet'").fetchall()
    got = decontamination.query(spark, "/root/testdata/sf0.01").collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in brute.contaminated(docs, items).items()}
    assert len(got) > 5


def test_edited_and_odd_passages(spark):
    item = " ".join(f"word{k}" for k in range(60))
    near = item.split()
    near[59] = "other"
    far = [x if k % 7 else "z" for k, x in enumerate(item.split())]
    docs = [(1, "before it " + item.upper() + " after"), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, ""), (6, item[:40]), (1, "before it " + item.upper() + " after"), (None, item)]
    items = [(1, item), (2, item), (3, "too few words"), (4, None)]
    got = decontamination.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), decontamination.Search(max_items=1)).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(1, 1), (1, 2), (2, 1), (2, 2), (None, 1), (None, 2)], key=str)
    assert [r.start_word for r in got if r.doc_id == 1] == [2, 2]


def test_blocks_reach_every_fingerprint_in_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    items = decontamination.Items([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(30)], decontamination.Search())
    own = items.sizes[16]
    for k in range(30):
        for distance in (0, 7, decontamination.RADIUS):
            bits = rng.choice(64, distance, replace=False)
            changed = own["prints"][k] ^ np.bitwise_or.reduce(np.array([1 << int(b) for b in bits] or [0], np.uint64))
            ((_, member),) = items.candidates(np.array([changed], np.uint64), 16)
            assert k in member
