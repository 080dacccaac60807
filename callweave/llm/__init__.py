"""Operators for training data: dedup, mixing, sharding, tokenising, archives, search, filters."""
