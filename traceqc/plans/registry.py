"""All queries of the library and their SQL."""

from __future__ import annotations

from traceqc.plans import cohort_queries, linkage_queries, report_queries, signal_queries

_ALL = (report_queries, linkage_queries, signal_queries, cohort_queries)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _ALL for k, v in m.ORACLE.items()}
