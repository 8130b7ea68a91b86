"""Operators of a training-data pipeline: near-duplicates, tokens, packing, extraction, quality.

Nothing outside this package imports it.
"""
