"""Readers and writers, and adapters that give the test tables the shape of test-run data."""
