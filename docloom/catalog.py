"""Name -> query, and name -> DuckDB SQL, for the library's own operators."""

from __future__ import annotations

from docloom.plans import alert_queries, check_queries, evaluation_queries, index_queries, misc_queries, retrieval_queries, segment_queries, source_queries

_MODULES = (retrieval_queries, segment_queries, misc_queries, evaluation_queries, alert_queries, source_queries, index_queries, check_queries)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
