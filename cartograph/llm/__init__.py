"""Operators of a large-scale training-data pipeline, built on Spark DataFrames.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries and their SQL.
"""
