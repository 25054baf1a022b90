"""All registered queries of the mesh engine and their DuckDB SQL."""

from __future__ import annotations

from spindrift.plans import queries, shape_queries, workload_queries  # noqa: F401  (the latter two register more)

QUERIES = dict(queries.QUERIES)
ORACLE = dict(queries.ORACLE)
