"""Operators for training data: near-duplicates, token files, scores, filters and packing."""
