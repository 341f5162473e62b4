"""Parallel-corpus analytics on Spark: ingestion, validation, splitting, metrics, replay, registry and monitoring."""
