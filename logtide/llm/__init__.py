"""Operators for large training-data pipelines: filtering, deduplication, search, mixing, tokens and chat text."""
