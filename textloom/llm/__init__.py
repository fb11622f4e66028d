"""Operators of a large-scale training-data pipeline.

Self-contained: nothing else in the library imports this subpackage.
"""
