"""Retrieval-style data processing on Spark: ingest, search, registries, spend and rates, in batch and streams."""
