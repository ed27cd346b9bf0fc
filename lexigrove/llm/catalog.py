"""The queries of this subpackage and their SQL."""

from lexigrove.llm import queries_corpus, queries_neardup, queries_pages, queries_scores, queries_subjects, queries_terms

_MODULES = [queries_pages, queries_corpus, queries_neardup, queries_scores, queries_subjects, queries_terms]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
