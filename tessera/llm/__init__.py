"""Operators for training data: sampling, splits, near-duplicates, neighbours, tokens, packing and text quality.

Nothing outside this subpackage imports it.
"""
