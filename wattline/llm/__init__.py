"""Operators for training-data pipelines: deduplication, scoring, masking, mixing, encoding.

Nothing else in the library imports this package.
"""
