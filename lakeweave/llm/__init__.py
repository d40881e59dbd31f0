"""Operators for preparing training corpora: sharding, deduplication, scoring, packing, encoding."""
