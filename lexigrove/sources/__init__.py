"""Readers of documents, queries, annotations and runs."""
