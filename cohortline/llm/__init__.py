"""Operators of a training-data pipeline: quality, duplicates, tokens, leaks, PII, secrets, packing."""
