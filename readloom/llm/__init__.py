"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; `queries` holds the
entries that the top-level registry adds when the subpackage is present.
"""
