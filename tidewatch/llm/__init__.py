"""Operators for preparing text corpora: sharding, deduplication, filtering, tokenizing."""
