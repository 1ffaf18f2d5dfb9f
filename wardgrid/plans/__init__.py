"""Whole pipelines composed from operators, and their mapping onto the supplied tables."""
