"""Operators of a large-scale training-data pipeline, with their queries and SQL.

Nothing else in the library imports this subpackage.
"""
