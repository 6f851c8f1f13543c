"""Operators for building training corpora from raw text.

Nothing else in ``tessera`` imports this package, so it can be removed as a whole.
"""
