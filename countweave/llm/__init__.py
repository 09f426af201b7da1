"""Operators for training-data pipelines: filtering, deduplication, scoring, mixing and packing of texts."""
