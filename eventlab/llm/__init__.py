"""Operators of a training-data pipeline: deduplication, quality rules, mixing, sharding, packing."""
