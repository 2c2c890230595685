"""Operators of a training-data pipeline on Spark DataFrames.

Nothing outside this package imports it. Functions take DataFrames (and plain parameters)
and return DataFrames; ``queries`` holds the registered queries and their oracle SQL.
"""
