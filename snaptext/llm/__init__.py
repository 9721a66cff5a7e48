"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames,
reads only the columns it names (extra columns never clash, they are not carried unless said so), and
says in its docstring what it returns for nulls, empty texts, repeated rows and empty tables.
"""
