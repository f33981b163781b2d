"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; ``queries`` holds what the
driver entry registers.
"""
