"""Operators of a training-data pipeline: classifiers, deduplication, search, tokens, archives."""
