"""Corpus analytics on Spark: page ingestion, link graphs, search, glossaries and snapshots."""
