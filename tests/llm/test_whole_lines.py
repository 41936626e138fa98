"""Line deduplication against all earlier documents, with no limit on how many hold a line or how long lines are."""

from collections import defaultdict

import duckdb

from traceqc.llm import line_dedup


def held_by_earlier(rows, block=50):
    """{id: places}: lines in runs of ``block`` characters or more that a smaller id holds; ids and texts are distinct."""
    own = {i: [x.strip(" ") for x in t.split("\n")] for i, t in rows if t}
    runs = defaultdict(list)
    for i, ls in own.items():
        for p in range(len(ls)):
            for q in range(p + 1, len(ls) + 1):
                if sum(map(len, ls[p:q])) >= block:
                    runs[tuple(ls[p:q])].append((i, p, q))
                    if q - p >= 12:
                        break
    gone = defaultdict(set)
    for found in runs.values():
        low = min(found)[0]
        for i, p, q in found:
            if low < i:
                gone[i] |= set(range(p, q))
    return {i: sorted(g) for i, g in gone.items()}


def places(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.gone for r in line_dedup.removals(docs).collect()}


def test_a_line_that_every_document_holds_goes_from_all_but_the_first(spark):
    hot = "a line of more than fifty characters that stands in every document"
    rows = [(i, f"own {i}\n{hot}\nend {i}") for i in range(40)]
    assert places(spark, rows) == {i: [1] for i in range(1, 40)}


def test_a_block_goes_though_its_lines_stand_alone_in_earlier_documents(spark):
    one, two = "a line of thirty characters xx", "another of thirty characters y"
    rows = [(1, f"{one}\nfirst"), (2, f"second\n{two}"), (3, f"b\n{one}\n{two}\nbb"), (4, f"c\n{one}\n{two}\ncc")]
    assert places(spark, rows) == {4: [1, 2]}


def test_a_block_goes_though_the_first_holder_has_it_in_another_order(spark):
    one, two = [[f"{name} passage, line {k} of it" for k in range(3)] for name in ("some", "other")]
    rows = [(1, "\n".join(two + ["x"] + one)), (2, "\n".join(one + ["y"] + two))]
    assert places(spark, rows) == {2: [0, 1, 2, 4, 5, 6]}


def test_given_documents_lose_all_that_earlier_ones_hold(spark):
    rows = duckdb.sql("select min(doc_id), text from '/root/testdata/sf0.001/documents.parquet' where doc_id is not null group by text").fetchall()
    assert {i: g for i, g in places(spark, rows).items()} == held_by_earlier(rows)


def test_blocks_of_short_lines_go(spark):
    verse = "\n".join(f"verse {k} of a song" for k in range(30))
    rows = [(1, f"one\n{verse}\nend"), (2, f"two\n\n{verse}\n\nlast"), (3, "verse 4 of a song\nverse 5 of a song\nelse")]
    assert places(spark, rows) == {2: list(range(2, 32))}
