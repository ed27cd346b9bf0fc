"""All queries of the core and their SQL."""

from lexigrove.catalog import analytics, files, retrieval, rows

_MODULES = [retrieval, analytics, files, rows]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}

FLAGSHIP = "combine_dirichlet"
