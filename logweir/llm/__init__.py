"""Operators of a training-data pipeline over documents and web pages.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, reads only the columns it names, and lets rows with nulls,
empty texts, repeated ids and further columns through as its docstring says.
"""
