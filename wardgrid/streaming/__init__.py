"""Structured Streaming versions of the live-vitals operators."""
