"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; it imports nothing from the rest of the library.
"""
