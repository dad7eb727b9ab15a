"""Operators for large text corpora: deduplication, scoring, filtering, tokens and packing.

Nothing else in the library imports this subpackage.
"""
