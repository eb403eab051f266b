"""Operators of a training-data pipeline: deduplication, archives, sharding, packing, scoring, filtering."""
