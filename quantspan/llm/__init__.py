"""Operators for preparing language-model training data on Spark.

Nothing else in the library imports this subpackage. Every operator is a function from DataFrames
to DataFrames; the thin queries over the standard tables are in :mod:`quantspan.llm.queries`.
"""
