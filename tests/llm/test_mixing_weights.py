"""Nodes of weight 0 on each level of the tree, against SQL over the same rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from traceqc.llm import mixing

SOURCES = [("en", "src0"), ("en", "src4"), ("de", "src0"), ("de", "src8"), ("fr", "src1"), ("fr", "src5"), ("en", "src2")]


@pytest.mark.parametrize(
    "weights,share",
    [
        ({"domain": {}, "language": {"en": 0.0}, "leaf_source": {}}, 0.4),
        ({"domain": {"domain1": 0.0}, "language": {"de": 3.0}, "leaf_source": {}}, 0.5),
        ({"domain": {}, "language": {}, "leaf_source": {"src0": 0.0, "src4": 2.0}}, 0.5),
        ({"domain": {"domain0": 2.0}, "language": {"en": 0.0}, "leaf_source": {"src8": 0.0}}, 0.3),
    ],
)
def test_shortages_of_closed_nodes_go_to_open_ones(spark, weights, share):
    mix = mixing.Mix(weights=weights, budget_share=share, max_epochs=2)
    rows = [(100 * k + j, "word", lang, source) for k, (lang, source) in enumerate(SOURCES) for j in range(40 + 11 * k)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), mix)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(mixing.oracle_for(mix)).fetchall())
    closed = F.lit(False)
    for level in mixing.LEVELS:
        closed |= mixing.weight_of(level, mix) == 0
    assert got.where(closed).count() == 0
    # each leaf's budget is cut to whole tokens
    budget = int(len(rows) * share)
    selected = got.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    assert budget - len(SOURCES) < selected <= budget
