"""Operators for large training-data corpora.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
