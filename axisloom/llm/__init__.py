"""Operators for preparing training data: cleaning, near duplicates, tokens, media.

Nothing else in the library imports this subpackage.
"""
