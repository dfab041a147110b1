"""Operators for preparing training text: dedup, quality, privacy, mixing, tokens and sharding.

Nothing else in the package imports this subpackage.
"""
