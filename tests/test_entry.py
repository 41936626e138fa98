import importlib
import sys

import pytest


def test_queries_and_sql_belong_together():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_the_rest_works_without_the_llm_parts(monkeypatch):
    """As if the folders of the subpackage and the pipeline were deleted."""

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("traceqc.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m in ("corpus_pipeline", "__spark_entry__") or m.startswith("traceqc.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    import traceqc

    monkeypatch.delattr(traceqc, "llm", raising=False)
    e = importlib.import_module("__spark_entry__")
    assert "l7_linked_reports" in e.queries() and "pipeline" not in e.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.parametrize("name", ["l7_linked_reports", "t9_reports"])
def test_flagship(spark, name):
    import __spark_entry__ as e

    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
