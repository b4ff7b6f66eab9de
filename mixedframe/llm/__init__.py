"""Operators for preparing training data: search, near-duplicates, filters, mixing, packing.

Nothing outside this package imports it.
"""
