"""Operators of a training-data pipeline: packing, deduplication, language, fingerprints, shards, captures, pieces, privacy, quality."""
