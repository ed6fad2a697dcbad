"""Operators for training data: search, deduplication, filters, packing, archives."""
