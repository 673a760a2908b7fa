"""Operators for training-data pipelines: filters, deduplication, tokens, search.

Nothing else in the library imports this subpackage.
"""
