"""Operators for building training corpora, each a function from DataFrames to a DataFrame.

Nothing outside this folder imports it; its queries are added in ``__spark_entry__``.
"""
