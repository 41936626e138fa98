"""Tables whose last trace is cut short, or has holes: spectral queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as e

#: Samples of the last trace that are there: a part of the first half, one of the second, and only its start.
CUTS = {"first half": 114, "second half": 120, "start": 113}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders with ``embeddings`` by name."""
    given, out = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), {}
    for name, n in {**CUTS, "holes": 125}.items():
        out[name] = str(tmp_path_factory.mktemp("cut"))
        kept = given.where(f"vec_id < {n}" + (" and vec_id not in (15, 16, 40, 41, 42, 43, 44, 45, 46, 47, 66)" if name == "holes" else ""))
        kept.coalesce(1).write.parquet(f"{out[name]}/embeddings.parquet")
    return out


def compared(spark, folder, query):
    """Rows of the query and of its SQL, by key."""
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    keys = 1 if query == "c32_mean_spectrum" else 3
    by_key = lambda rows: {tuple(r[:keys]): pytest.approx(tuple(r[keys:]), abs=2e-6) for r in rows}
    return {tuple(r[:keys]): tuple(r[keys:]) for r in e.queries()[query](spark, folder).collect()}, by_key(con.execute(e.oracle_sql()[query]).fetchall())


@pytest.mark.parametrize("table", [*CUTS, "holes"])
@pytest.mark.parametrize("query", ["q9_spectra", "q13_alpha_variation", "q14_halves", "q15_start", "c32_mean_spectrum"])
def test_traces_cut_short(spark, tables, query, table):
    got, want = compared(spark, tables[table], query)
    assert got == want
