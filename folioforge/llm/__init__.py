"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames and has an interface of its own; `queries` holds the thin registered
queries, which only choose tables and parameters and derive digest columns.
"""
