"""Operators for large training-data pipelines.

Nothing else in the library imports this package.  Each module holds one
operator with its own interface; ``queries`` registers the thin ``opN_`` queries
and their SQL twins.
"""
