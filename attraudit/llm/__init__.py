"""Operators for training-data corpora: tokenizing, cleaning, deduplication, search and archives."""
