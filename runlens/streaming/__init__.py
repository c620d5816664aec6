"""Structured Streaming forms of the recorder folds and the legacy ingest."""
