"""Operators for training-data pipelines (deduplication, filtering, extraction,
packing). Nothing else in the library imports this subpackage."""
