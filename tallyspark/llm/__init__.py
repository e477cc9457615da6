"""Operators for training data: grouping, mapping, overlap, canonical text, token ids, mixing, subjects.

Nothing else in the library imports this package.
"""
