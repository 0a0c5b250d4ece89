"""Operators for preparing text corpora: reading, deduplicating, scoring, filtering and tokenizing.

Nothing else in the library imports this package.
"""
