"""Structured Streaming monitors for volume, fairness, performance and drift."""
