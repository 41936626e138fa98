"""The whole pipeline against a plain version, stage by stage."""

import brute
import duckdb
import pytest

import corpus_pipeline
from traceqc.llm import mixing, quality_rules

SF = "/root/testdata/sf0.001"


def plain_rows(name):
    return duckdb.sql(f"select * from '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def expected():
    """(doc_id, text) after each of the first four stages, and the mixture of the last."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"select doc_id from ({quality_rules.ORACLE}) where kept").fetchall()}
    rows = [r for r in plain_rows("documents") if r[0] in kept]
    out = [{r[0]: r[1] for r in rows}]
    gone = brute.line_dedup([(r[0], r[1]) for r in rows])
    after = []
    for k, r in enumerate(rows):
        if k in gone:
            text = "" if gone[k] is None else "\n".join(x for p, x in enumerate(r[1].split("\n")) if p not in gone[k])
            if not text.strip(" "):
                continue
            r = (r[0], text, r[2], r[3], len(text))
        after.append(r)
    out.append({r[0]: r[1] for r in after})
    low = {i: c for i, _, c in brute.components([(r[0], r[1]) for r in after], 5, 80)}
    after = [r for r in after if low[r[0]] == r[0]]
    out.append({r[0]: r[1] for r in after})
    dirty = {d for d, _ in brute.contaminated([(r[0], r[1]) for r in after], plain_rows("benchmark"))}
    after = [r for r in after if r[0] not in dirty]
    out.append({r[0]: r[1] for r in after})
    con.execute("drop view documents")
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", after)
    copies = {r[0]: r[1] for r in con.execute(f"select doc_id, copies from ({mixing.ORACLE})").fetchall()}
    out.append(sorted((r[0], r[1], r[2], r[3], r[4], e) for r in after for e in range(copies.get(r[0], 0))))
    return out


def test_each_stage(spark, expected, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            assert {r.doc_id: r.text for r in docs.collect()} == expected[k], name
        else:
            assert sorted(tuple(r) for r in docs.collect()) == expected[k], name


def test_run(spark, expected):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == expected[4]


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
